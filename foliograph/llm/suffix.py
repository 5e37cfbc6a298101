"""Exact repeated-substring removal by distributed prefix doubling.

A string of ``min_bytes`` bytes that starts at two places of the corpus is a repeat, and
every byte that a repeat covers is removed. Texts are UTF-8 bytes, strings never cross
documents, and the first occurrence goes like any other.

Method. Inside a text, prefix doubling gives every byte position a 64-bit name for its
prefix of 1, 2, 4, ... bytes: the name of 2h bytes is the name of the pair of ranks at
offset h (overlapping pairs give lengths between two powers). Names stand for ranks, as
equal prefixes have equal names; so no position has to travel for the short offsets,
where nearly all of them repeat. Over the corpus, Spark sorts position and rank pairs at
two growing offsets, equal neighbours are reranked, and what is unique drops out:

1. Only sampled positions travel at first. Each start of a string is owned by the
   smallest 16-byte name of its first ``window`` positions, which depends on content only,
   so equal strings have owners at equal offsets. A run of starts with one owner is a
   segment. Pairs (rank of the prefix shared by all strings of the segment, rank of the
   whole segment) are sorted. A segment whose first rank is unique is done: none of its
   strings repeats. A segment whose pair repeats is done: all of them do.
2. What is left, and one representative of each repeated segment beside it, sends pairs
   of ranks that reach the threshold, for each of its strings; those are sorted once more.

Names repeated inside a task go into a shuffle once, so a passage that a third of all
documents share costs a row for each task. A prefix that many documents continue in
different ways can't be merged so; such prefixes are looked for in a sample of documents
and dealt by their whole pair, which decides the same segments. Sorted rows are read in
batches and only a run of equal first ranks is held. Parts are sized by the bytes of all
texts, so a task's memory doesn't follow the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

U64 = np.uint64
LOW = U64(0xFFFFFF)
#: Starts that are named at once, and text bytes whose segments are packed together.
UNIT, BLOCK = 1 << 20, 16 << 20
#: Stands for a null doc_id where documents are looked up.
NO_ID = -(1 << 63)
REPEATED, OPEN, WITNESS = 1, 2, 3
#: Text bytes of a part, and rows that are packed together.
PART_BYTES, PACK_ROWS = 24 << 20, 200_000
#: Rows whose texts become Python objects at once.
SLICE = 256
#: One of so many documents is looked at for frequent prefixes; of those so many are dealt apart.
SAMPLED, HOT = 64, 10_000
#: Flags of a segment: more of it in its task, repeated in its task, a frequent prefix.
MANY, KNOWN, FREQUENT = 1, 2, 4
#: Flag of a string that wants to know, and strings that are named together.
ASKING, STRINGS_AT_ONCE = 8, 1_000_000


class Names:
    """Names of the prefixes of every position of a buffer, by doubling."""

    def __init__(self, data: np.ndarray, longest: int, seed: int = 0):
        rng = np.random.Generator(np.random.PCG64(0x5EED + seed))
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.a, self.b = (U64(x | 1) for x in rng.integers(1, 1 << 63, 2, dtype=np.uint64))
        self.levels = {1: table[data]}
        h = 1
        while 2 * h <= min(longest, len(data)):
            x = self.levels[h]
            self.levels[2 * h] = self.pair(x[:-h], x[h:])
            if h != 16:  # only lengths that are asked for stay
                del self.levels[h]
            h *= 2

    def pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x * self.a
        out += y
        out ^= out >> U64(32)
        out *= self.b
        out ^= out >> U64(29)
        return out

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings of this length at these positions."""
        h = max(k for k in self.levels if k <= length)
        level = self.levels[h]
        return level[at] if h == length else self.pair(level[at], level[at + (length - h)])


def window_of(min_bytes: int) -> int:
    return max(1, int(min_bytes * 0.28))


def owners(names: Names, window: int) -> np.ndarray:
    """For each position, the position of the smallest 16-byte name from there."""
    h = names.levels[16]
    low = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: -(window - size)], low[window - size :])
    return (low & LOW).astype(np.int64)


def spans_of(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those from starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts) if len(ends) else np.empty(0, np.int64)


def segments(texts: list[bytes], min_bytes: int) -> dict[str, np.ndarray]:
    """Segments of the texts: text (index), pos, ln (starts), core and full names."""
    window, found = window_of(min_bytes), []

    def name(units: list[tuple[int, int, bytes]]) -> None:
        sizes = np.array([len(x) for _, _, x in units])
        starts = np.cumsum(sizes) - sizes
        names = Names(np.frombuffer(b"".join(x for _, _, x in units), np.uint8), min_bytes)
        own = owners(names, window)
        counts = sizes - min_bytes + 1
        at, unit = spans_of(counts, starts), np.repeat(np.arange(len(units)), counts)
        own = own[at]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (unit[1:] != unit[:-1])])
        last = np.r_[cut[1:], len(at)] - 1
        first, end, unit = at[cut], at[last], unit[cut]
        full = names.pair(names.of(first, min_bytes), names.of(end, min_bytes))
        full = names.pair(full, ((own[cut] - first) * 65536 + (end - first)).astype(np.uint64))
        place = np.array([at for _, at, _ in units])[unit] + first - starts[unit]
        found.append({"text": np.array([k for k, _, _ in units])[unit], "pos": place.astype(np.uint32), "ln": (end - first + 1).astype(np.uint16), "core": names.of(own[cut], min_bytes - window + 1), "full": full})

    units, total = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - min_bytes + 1, UNIT):
            units.append((k, at, text[at : at + UNIT + min_bytes - 1]))
            total += len(units[-1][2])
            if total >= UNIT:
                name(units)
                units, total = [], 0
    if units:
        name(units)
    kinds = {"text": np.int64, "pos": np.uint32, "ln": np.uint16, "core": U64, "full": U64}
    return {c: np.concatenate([x[c] for x in found]) if found else np.empty(0, t) for c, t in kinds.items()}


def parts_of(doc: np.ndarray, crc: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document, by its id and text, as part_column() gives it."""
    order = np.lexsort((crc, doc))
    starts = runs(doc[order], crc[order])
    own = [zlib.crc32(f"{d}:{c}".encode()) % parts for d, c in zip(doc[order][starts].tolist(), crc[order][starts].tolist(), strict=True)]
    out = np.empty(len(doc), np.int64)
    out[order] = np.repeat(np.array(own, np.int64), np.diff(np.r_[starts, len(doc)]))
    return out


def part_column(parts: int) -> Column:
    key = F.concat_ws(":", F.coalesce("doc_id", F.lit(NO_ID)).cast("string"), F.crc32("bytes").cast("string"))
    return F.pmod(F.crc32(key), F.lit(parts)).cast("int")


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, change])


#: A segment's first rank; the other half of its pair's rank over the text's checksum;
#: the document; position, starts and flags. A string's rank in two parts; flags; its
#: part and number there. Fields share longs, as rows are what the shuffles weigh.
SEGMENTS = "core long, full_crc long, doc long, place long"
STRINGS = "a long, b_flags long, place long"
STATUS = {"doc": "<i8", "crc": "<u4", "pos": "<u4", "ln": "<u2", "status": "<u1"}


def packed(part: np.ndarray, arrays: dict[str, np.ndarray], kinds: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """A row for each part, its arrays as bytes."""
    order = np.argsort(part, kind="stable")
    starts = runs(part[order])
    ends = np.r_[starts, len(order)][1:]
    rows = {"part": pa.array(part[order][starts].astype(np.int32), pa.int32())}
    for c, kind in kinds.items():
        data = arrays[c].astype(kind)[order]
        rows[c] = pa.array([data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())
    if len(starts):
        yield pa.record_batch(rows)


def unpacked(batches: list[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(x.as_py() or b"" for r in batches for x in r.column(c)), kind) for c, kind in kinds.items()}


def packed_schema(kinds: dict[str, str]) -> str:
    return ", ".join(["part int", *(f"{c} binary" for c in kinds)])


class Gathered:
    """Arrays that are packed together once there are enough of them."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds, self.found, self.size = kinds, [], 0

    def add(self, part: np.ndarray, arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.found.append((part, {c: arrays[c] for c in self.kinds}))
        self.size += len(part)
        if self.size >= PACK_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from packed(np.concatenate([p for p, _ in self.found]), {c: np.concatenate([x[c] for _, x in self.found]) for c in self.kinds}, self.kinds)
        self.found, self.size = [], 0


def text_blocks(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of the texts that have a string, about BLOCK bytes at once."""
    ids, texts, total = [], [], 0
    for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if len(text) >= min_bytes:
                ids.append(doc_id)
                texts.append(text)
                total += len(text)
            if total >= BLOCK:
                yield ids, texts
                ids, texts, total = [], [], 0
    if texts:
        yield ids, texts


def frequent_prefixes(docs: DataFrame, min_bytes: int, parts: int) -> np.ndarray:
    """Sorted names of the first ranks that would fill a quarter of a part and more.

    Counted in one of SAMPLED documents. They only tell how rows are dealt: no result
    depends on them, so the HOT most frequent are enough.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches, min_bytes):
            core, n = np.unique(segments(texts, min_bytes)["core"], return_counts=True)
            yield pa.record_batch({"core": pa.array(core.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "bytes"), F.lit(SAMPLED)) == 0).select(F.coalesce("doc_id", F.lit(NO_ID)), "bytes")
    counts = some.mapInArrow(rows, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(8, total // (4 * parts))).orderBy(F.col("n").desc(), "core").limit(HOT).collect()
    return np.sort(np.array([r["core"] for r in found], np.int64).view(U64))


def named_segments(docs: DataFrame, min_bytes: int, hot: np.ndarray) -> DataFrame:
    """Round 1, map side: rank pairs of all segments, one row for each pair in a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, min_bytes):
            found = segments(texts, min_bytes)
            found["full"] >>= U64(32)  # with the first rank, 96 bits
            order = np.lexsort((found["full"], found["core"]))
            found = {c: x[order] for c, x in found.items()}
            first = runs(found["core"], found["full"])
            flags = np.full(len(order), KNOWN)
            flags[first] = np.where(np.diff(np.r_[first, len(order)]) > 1, MANY, 0)
            flags |= np.where(np.isin(found["core"], hot), FREQUENT, 0)
            doc = np.array(ids, np.int64)[found["text"]]
            crc = np.array([zlib.crc32(x) for x in texts], np.uint64)[found["text"]]
            full_crc = (found["full"] << U64(32) | crc).view(np.int64)
            place = found["pos"].astype(np.int64) << 24 | found["ln"].astype(np.int64) << 8 | flags
            yield pa.record_batch({"core": pa.array(found["core"].view(np.int64)), "full_crc": pa.array(full_crc), "doc": pa.array(doc), "place": pa.array(place)})

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)), "bytes").mapInArrow(rows, SEGMENTS)


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def whole_runs(batches: Iterator[pa.RecordBatch], group: Callable[[dict[str, np.ndarray]], tuple], rows: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], apart: Callable[[dict[str, np.ndarray]], np.ndarray], also: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """rows() of sorted batches, cut between two groups only; apart rows go to also()."""
    rest = None
    for batch in batches:
        x = _arrays(batch)
        alone = apart(x)
        if alone.any():
            yield from also({c: v[alone] for c, v in x.items()})
            x = {c: v[~alone] for c, v in x.items()}
        rest = x if rest is None else {c: np.concatenate([rest[c], x[c]]) for c in x}
        starts = runs(*group(rest))
        if len(starts) > 1:
            yield from rows({c: v[: starts[-1]] for c, v in rest.items()})
            rest = {c: v[starts[-1] :] for c, v in rest.items()}
    if rest is not None and len(rest["place"]):
        yield from rows(rest)


def _flag(c: str, flag: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(flag)) > 0


def ranked_segments(named: DataFrame, parts: int) -> DataFrame:
    """Round 1, reduce side: the segments that aren't done or that repeat, by document.

    Spark deals rows by their first rank (frequent ones by the pair, known ones anyhow)
    and sorts them by the pair.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(STATUS)

        def told(x: dict[str, np.ndarray], status: np.ndarray) -> Iterator[pa.RecordBatch]:
            crc = x["full_crc"] & 0xFFFFFFFF
            yield from gathered.add(parts_of(x["doc"], crc, parts), {"doc": x["doc"], "crc": crc, "pos": x["place"] >> 24, "ln": x["place"] >> 8 & 0xFFFF, "status": status})

        def reranked(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            n = len(x["place"])
            pair, core = runs(x["core"], x["full_crc"] >> 32), runs(x["core"])
            in_pair = np.repeat(np.arange(len(pair)), np.diff(np.r_[pair, n]))
            in_core = np.repeat(np.arange(len(core)), np.diff(np.r_[core, n]))
            weight, frequent = 1 + (x["place"] & MANY), (x["place"] & FREQUENT) > 0
            repeated = np.bincount(in_pair, weight, len(pair))[in_pair] > 1
            alive = frequent | (np.bincount(in_core, weight, len(core))[in_core] > 1)
            undecided = frequent | (np.bincount(in_core, alive & ~repeated, len(core))[in_core] > 0)
            head = np.zeros(n, bool)
            head[pair] = True
            status = np.where(repeated, np.where(undecided & head, WITNESS, REPEATED), OPEN)
            yield from told({c: v[alive] for c, v in x.items()}, status[alive])

        yield from whole_runs(batches, lambda x: (x["core"], np.where((x["place"] & FREQUENT) > 0, x["full_crc"] >> 32, 0)), reranked, lambda x: (x["place"] & KNOWN) > 0, lambda x: told(x, np.full(len(x["place"]), REPEATED)))
        yield from gathered.rest()

    deal = F.when(_flag("place", KNOWN), F.xxhash64("doc", "place")).when(_flag("place", FREQUENT), F.xxhash64("core", F.shiftright("full_crc", 32))).otherwise(F.col("core"))
    return named.repartition(parts, deal).sortWithinPartitions("core", "full_crc").mapInArrow(rows, packed_schema(STATUS))


class Statuses:
    """The statuses of the documents of a task."""

    def __init__(self, batches: list[pa.RecordBatch]):
        x = unpacked(batches, STATUS)
        order = np.lexsort((-x["status"].astype(np.int8), x["pos"], x["crc"], x["doc"]))
        x = {c: v[order] for c, v in x.items()}
        starts = runs(x["doc"], x["crc"])
        ends = np.r_[starts, len(order)][1:].tolist()
        self.rows = x
        self.at = dict(zip(zip(x["doc"][starts].tolist(), x["crc"][starts].tolist(), strict=True), zip(starts.tolist(), ends, strict=True), strict=True))

    def of(self, doc_id: int | None, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(spans of the repeats known so far, (pos, ln, open) of what is undecided)."""
        i, j = self.at.get((NO_ID if doc_id is None else doc_id, zlib.crc32(text)), (0, 0))
        pos, ln, status = (self.rows[c][i:j].astype(np.int64) for c in ("pos", "ln", "status"))
        # rows that are given twice have each segment twice, a witness before the others
        keep = np.ones(j - i, bool)
        keep[1:] = pos[1:] != pos[:-1]
        pos, ln, status = pos[keep], ln[keep], status[keep]
        known, asked = status != OPEN, status != REPEATED
        return np.stack([pos[known], pos[known] + ln[known]], 1), np.stack([pos[asked], ln[asked], status[asked] == OPEN], 1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and maximal spans that cover the same places."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[cut, 0], reach[np.r_[cut[1:] - 1, len(spans) - 1]]], 1)


def within_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without characters that they cover in part."""
    out = []
    for i, j in spans.tolist():
        while i < j and text[i] & 0xC0 == 0x80:
            i += 1
        while i < j < len(text) and text[j] & 0xC0 == 0x80:
            j -= 1
        if i < j:
            out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


def without(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def string_names(text: bytes, asked: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit names of the strings of the asked segments, in their order."""
    a, b = [], []
    for k in range(0, len(asked), 1024):
        some = asked[k : k + 1024]
        sizes = some[:, 1] + min_bytes - 1
        data = np.frombuffer(text, np.uint8)[spans_of(sizes, some[:, 0])]
        at = spans_of(some[:, 1], np.cumsum(sizes) - sizes)
        a.append(Names(data, min_bytes).of(at, min_bytes))
        b.append((Names(data, min_bytes, 1).of(at, min_bytes) >> U64(32)).astype(np.uint32))
    return np.concatenate(a), np.concatenate(b)


def documents_with_statuses(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Statuses, pa.RecordBatch]]:
    """Rows come sorted by part, then statuses before documents."""
    part, gathered, statuses = None, [], None
    for batch in batches:
        for first, size in _stretches(batch.column("part").to_numpy(), batch.column("kind").to_numpy()):
            rows = batch.slice(first, size)
            own, kind = rows.column("part")[0].as_py(), rows.column("kind")[0].as_py()
            if own != part:
                part, gathered, statuses = own, [], None
            if kind == 0:
                gathered.append(rows)
            else:
                if statuses is None:
                    statuses, gathered = Statuses(gathered), []
                for at in range(0, size, SLICE):
                    yield part, statuses, rows.slice(at, SLICE)


def _stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    starts = runs(*keys)
    return list(zip(starts.tolist(), np.diff(np.r_[starts, len(keys[0])]).tolist(), strict=True))


def find_repeats(docs: DataFrame, min_bytes: int = 400, whole_characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, extra) for each document.

    spans are the maximal removed runs [start, stop), kept the remaining bytes and extra
    the other columns of docs as a struct. whole_characters leaves characters that would
    lose a part of their bytes. A null text is empty; texts shorter than
    min_bytes lose nothing; a row given twice counts as two documents, so all of its
    long strings repeat; an empty table gives no rows.
    """
    if min_bytes < 64:
        raise ValueError("min_bytes must be 64 at least")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<none:int>")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("bytes"), extra.alias("extra"))
    size = base.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), -(-size // PART_BYTES))
    plain = base.select("doc_id", "bytes")
    statuses = ranked_segments(named_segments(plain, min_bytes, frequent_prefixes(plain, min_bytes, parts)), parts)
    texts = base.select(part_column(parts).alias("part"), F.lit(1).alias("kind"), "doc_id", "bytes", "extra")
    both = texts.unionByName(statuses.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "kind", "doc_id")
    extra_type = base.schema["extra"].dataType
    result = T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary").add("extra", extra_type)
    carried = T.StructType.fromDDL("part int, kind int, doc_id long, bytes binary, spans binary, asked binary").add("extra", extra_type)
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finished(ids: list, texts: list[bytes], spans: list[np.ndarray], extras: pa.Array) -> pa.RecordBatch:
        if whole_characters:
            spans = [within_characters(t, s) for t, s in zip(texts, spans, strict=True)]
        kept = [without(t, s) for t, s in zip(texts, spans, strict=True)]
        told = [[{"start": i, "stop": j} for i, j in s.tolist()] for s in spans]
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": pa.array(told, arrow_spans), "kept": pa.array(kept, pa.binary()), "extra": extras})

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, statuses, rows in documents_with_statuses(batches):
            ids, texts, spans, at = [], [], [], []
            for k, (doc_id, text) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("bytes").to_pylist(), strict=True)):
                known, asked = statuses.of(doc_id, text)
                if not asked[:, 2].any():
                    ids.append(doc_id)
                    texts.append(text)
                    spans.append(merged(known + [0, min_bytes - 1]))
                    at.append(k)
            if ids:
                yield finished(ids, texts, spans, rows.column("extra").take(pa.array(at, pa.int64())))

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, int, bytes, np.ndarray, np.ndarray]]:
        for part, statuses, rows in documents_with_statuses(batches):
            for k, (doc_id, text) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("bytes").to_pylist(), strict=True)):
                known, asked = statuses.of(doc_id, text)
                if len(asked):
                    yield part, rows, k, text, known, asked

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for part, rows, k, text, known, asked in undecided(batches):
            at = at if part == last else 0
            last = part
            if asked[:, 2].any():
                spans = np.r_[[[at, 0]], known + [0, min_bytes - 1]].astype("<i8")
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "kind": pa.array([1], pa.int32()), "doc_id": rows.column("doc_id").slice(k, 1), "bytes": pa.array([text], pa.binary()), "spans": pa.array([spans.tobytes()], pa.binary()), "asked": pa.array([asked.astype("<i8").tobytes()], pa.binary()), "extra": rows.column("extra").slice(k, 1)})
            at += int(asked[:, 1].sum())

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Round 2, map side: names of single strings, equal ones of a block once; at
        counts those of a part."""
        last, at, found, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            a, b, place, asking = (np.concatenate([f[k] for f in found]) for k in range(4))
            order = np.lexsort((b, a))
            first = runs(a[order], b[order])
            flags = np.full(len(order), KNOWN)
            flags[first] = np.where(np.diff(np.r_[first, len(order)]) > 1, MANY, 0)
            sent = (flags != KNOWN) | asking[order]
            order, flags = order[sent], flags[sent] | np.where(asking[order][sent], ASKING, 0)
            b_flags = b[order].astype(np.int64) << 8 | flags
            return pa.record_batch({"a": pa.array(a[order].view(np.int64)), "b_flags": pa.array(b_flags), "place": pa.array(place[order])})

        for part, _, _, text, _, asked in undecided(batches):
            at = at if part == last else 0
            last = part
            a, b = string_names(text, asked, min_bytes)
            found.append((a, b, part << 32 | np.arange(at, at + len(a)), np.repeat(asked[:, 2] > 0, asked[:, 1])))
            at, size = at + len(a), size + len(a)
            if size >= STRINGS_AT_ONCE:
                yield flush()
                found, size = [], 0
        if found:
            yield flush()

    def repeated_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Round 2, reduce side: the strings of undecided segments that repeat."""
        gathered = Gathered({"at": "<u4"})

        def told(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield from gathered.add(x["place"] >> 32, {"at": x["place"] & 0xFFFFFFFF})

        def reranked(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            pair = runs(x["a"], x["b_flags"] >> 8)
            in_pair = np.repeat(np.arange(len(pair)), np.diff(np.r_[pair, len(x["a"])]))
            hit = (np.bincount(in_pair, 1 + (x["b_flags"] & MANY), len(pair))[in_pair] > 1) & ((x["b_flags"] & ASKING) > 0)
            yield from told({c: v[hit] for c, v in x.items()})

        yield from whole_runs(batches, lambda x: (x["a"], x["b_flags"] >> 8), reranked, lambda x: (x["b_flags"] & KNOWN) > 0, told)
        yield from gathered.rest()

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hits, known_hits = None, [], None
        for batch in batches:
            for first, size in _stretches(batch.column("part").to_numpy(), batch.column("kind").to_numpy()):
                rows = batch.slice(first, size)
                own, kind = rows.column("part")[0].as_py(), rows.column("kind")[0].as_py()
                if own != part:
                    part, hits, known_hits = own, [], None
                if kind == 0:
                    hits.extend(np.frombuffer(x, "<u4").astype(np.int64) for x in rows.column("at").to_pylist())
                    continue
                if known_hits is None:
                    known_hits = np.sort(np.concatenate([*hits, np.empty(0, np.int64)]))
                spans = []
                for told, asked in zip(rows.column("spans").to_pylist(), rows.column("asked").to_pylist(), strict=True):
                    known, asked = np.frombuffer(told, "<i8").reshape(-1, 2), np.frombuffer(asked, "<i8").reshape(-1, 3)
                    at = known[0, 0]
                    places = spans_of(asked[:, 1], asked[:, 0])
                    i, j = np.searchsorted(known_hits, [at, at + len(places)])
                    found = places[known_hits[i:j] - at]
                    spans.append(merged(np.r_[known[1:], np.stack([found, found + min_bytes], 1)]))
                yield finished(rows.column("doc_id").to_pylist(), rows.column("bytes").to_pylist(), spans, rows.column("extra"))

    hits = both.mapInArrow(strings, STRINGS).repartition(parts, F.when(_flag("b_flags", KNOWN), F.col("place")).otherwise(F.col("a"))).sortWithinPartitions("a", "b_flags").mapInArrow(repeated_strings, "part int, at binary")
    open_docs = both.mapInArrow(carry, carried).unionByName(hits.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.mapInArrow(decided, result).unionByName(open_docs.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(settled, result))


def text_columns(found: DataFrame) -> DataFrame:
    """Counts and the digest of what stays of each document, and that as text, where
    bytes of characters that were cut in two become U+FFFD."""
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
