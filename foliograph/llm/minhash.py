"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Each text becomes its set of word shingles; equal sets are one class from here on.
2. A signature has COORDINATES minima. A class is posted under each (coordinate, value).
3. Two sets that agree in ``matches`` coordinates or more agree in one of the
   COORDINATES - matches + 1 rarest coordinate values of either (prefix filter), so only
   those are posted, and values that a single class has are never posted. What a third
   of all documents share is frequent, comes last and is skipped, unless a set is made
   of little else.
4. Under a value, classes gather round a pivot, the one that shares most. All classes of
   one pivot form a cell, so a pair that meets under many values meets once. Cells are
   dealt out in blocks of bounded bytes and bounded numbers of classes, the pivot in
   each. In a block, collisions of signatures are counted for one class against the
   others, classes that are linked already are skipped, pairs at the match threshold or
   above are confirmed on the full sets, and a block tells no more links than connect
   its classes.
5. Cells of several blocks whose classes aren't one component yet: two classes of one
   such cell that link share one of the rarest shingles of either (a prefix filter on
   the sets themselves, which is exact). Those shingles are posted; under each, classes
   outside its most frequent component meet the others, in blocks again. Pairs that
   sizes or positions rule out are dropped, the others are confirmed on the full sets.
   Shingles of one component alone are skipped, so neither a common opening of texts
   that differ nor a large linked group makes pairs.
6. Links become components; a document's component is the smallest doc_id reachable.

Keys that more than a thousandth of all rows share (values, pivots, shingles, classes)
are dealt to many tasks in every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_texts, hot_join, with_totals
from .components import components
from .suffix import runs, spans_of

U64 = np.uint64
#: With 96 coordinates, a pair of similarity 0.75 agrees in 72 of them on average, and
#: in fewer than 52 in about 2 of a million cases.
COORDINATES, MATCHES = 96, 52
SHINGLE, PERCENT = 5, 75
#: Bytes of shingles and number of classes in a block, at most about.
BLOCK_BYTES, BLOCK_CLASSES = 4 << 20, 512
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(0xC0FFEE))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U64)
for _k in range(65, 91):  # A-Z count as a-z
    _BYTE[_k] = _BYTE[_k + 32]
_BASE, _MIX, _PLACE, _SUM = (_RNG.integers(1, 1 << 63, n, dtype=U64) | U64(1) for n in (1, 2, 8, 2))
_XOR, _MULTIPLY = (_RNG.integers(1, 1 << 63, COORDINATES, dtype=U64) | U64(1) for _ in range(2))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x *= _MIX[0]
    x ^= x >> U64(29)
    x *= _MIX[1]
    x ^= x >> U64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; they grow with the longest text seen."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        inverse = U64(pow(int(_BASE[0]), -1, 1 << 64))
        _POWERS[0] = np.cumprod(np.full(size, _BASE[0], U64))
        _POWERS[1] = np.cumprod(np.full(size, inverse, U64))
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingle hashes of each text, one after the other."""
    if not texts:
        return np.empty(0, U64), np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    text_at = np.cumsum(lengths) - lengths
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=U64)])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    words = _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64))
    text = np.searchsorted(text_at, starts, side="right") - 1
    n_words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    n_shingles = np.where(n_words >= size, n_words - size + 1, n_words > 0)
    at = spans_of(n_shingles, first)
    of = np.repeat(np.arange(len(texts)), n_shingles)
    short = n_words[of] < size
    hashes = np.zeros(len(at), U64)
    for k in range(size):
        j = np.minimum(at + k, len(words) - 1) if len(words) else at
        inside = (k < n_words[of]) if len(at) else np.empty(0, bool)
        hashes += np.where(inside, _mix(words[j] * _PLACE[k] + _PLACE[k]), U64(0))
    hashes = _mix(hashes + np.where(short, (n_words[of] * 7).astype(U64), U64(0)))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    keep = runs(of, hashes)
    return hashes[keep], np.bincount(of[keep], minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of COORDINATES 32-bit minima for each set that isn't empty."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for a in range(0, len(starts), 512):  # what is worked on at once stays in the caches
        i = starts[a]
        j = starts[a + 512] if a + 512 < len(starts) else len(hashes)
        own, at = hashes[i:j], starts[a : a + 512] - i
        for k in range(COORDINATES):
            out[a : a + 512, k] = np.minimum.reduceat((own ^ _XOR[k]) * _MULTIPLY[k], at) >> U64(32)
    return out


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or b"")
            total += len(texts[-1])
            if total >= CHUNK:
                yield ids, texts
                ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, signature) of each row; h1 and h2 name the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            hashes, counts = shingle_sets(texts, size)
            full = counts > 0
            starts = (np.cumsum(counts) - counts)[full]
            names = np.zeros((2, len(ids)), np.int64)
            if len(starts):
                for k in range(2):
                    names[k, full] = np.add.reduceat(_mix(hashes * _SUM[k]), starts).view(np.int64)
            signs = [None] * len(ids)
            for k, row in zip(np.flatnonzero(full), signatures(hashes, counts), strict=True):
                signs[k] = row.tobytes()
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(counts.astype(np.int64)), "h1": pa.array(names[0]), "h2": pa.array(names[1]), "signature": pa.array(signs, pa.binary())})

    return doc_texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def coordinate_values(classes: DataFrame) -> DataFrame:
    """(value, doc): a row for each class and coordinate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                yield pa.record_batch({"value": pa.array((signs + tags).ravel()), "doc": pa.array(np.repeat(part.column(0).to_numpy(), COORDINATES))})

    return classes.select("doc", "signature").mapInArrow(rows, "value long, doc long")


def prefix_postings(classes: DataFrame, scratch: Scratch, matches: int = MATCHES) -> DataFrame:
    """(value, doc, shared): the shared values among each class's rarest coordinates."""
    values = coordinate_values(classes)
    frequent = scratch.save(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "frequent-values")
    own = hot_join(values, frequent, "value", "df", "doc").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    prefix = F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("own"))
    return own.where((F.size("own") >= matches) & (prefix > 0)).select("doc", F.size("own").alias("shared"), F.explode(F.slice("own", F.lit(1), prefix)).alias("x")).select(F.col("x.value").alias("value"), "doc", "shared")


def pivot_cells(postings: DataFrame, sizes: DataFrame, scratch: Scratch, block_bytes: int, block_classes: int) -> DataFrame:
    """(pivot, doc, block, blocks): the members of each cell, the pivot in every block."""
    best = postings.groupBy("value").agg(F.max(F.struct("shared", (-F.col("doc")).alias("doc"))).alias("x"), F.count("*").alias("n")).where("n > 1").select("value", (-F.col("x.doc")).alias("pivot"), "n")
    met = hot_join(postings.select("value", "doc"), scratch.save(best, "pivots"), "value", "n", "doc")
    members = met.where("doc != pivot").select("pivot", "doc").distinct().join(sizes, "doc")
    totals = {"bytes": (F.sum, F.col("n") * 8), "classes": (F.sum, F.lit(1))}
    blocks = F.greatest(F.ceil(F.col("bytes") / block_bytes), F.ceil(F.col("classes") / block_classes)).cast("int")
    sized = with_totals(members, "pivot", totals, "doc").withColumn("blocks", blocks)
    dealt = sized.select("pivot", "doc", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "blocks")
    blocks = dealt.select("pivot", "blocks").distinct()
    return dealt.unionByName(blocks.select("pivot", F.col("pivot").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks"))


class Links:
    """Links between the sets of a block."""

    def __init__(self, sets: list[np.ndarray], matches: int, percent: int):
        self.sets, self.matches, self.percent = sets, matches, percent
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.signs = signatures(flat, self.sizes)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        starts = runs(flat[order])
        ends = np.r_[starts, len(order)][1:]
        self.owners = owner[order]
        ranks = np.empty(len(flat), np.int64)
        ranks[order] = np.repeat(np.arange(len(starts)), ends - starts)
        self.begin, self.count = starts, ends - starts
        self.ranks = np.split(ranks, np.cumsum(self.sizes)[:-1])

    def near(self, k: int, among: np.ndarray) -> np.ndarray:
        """Those among the sets (a mask) that link with set k."""
        hit = among & ((self.signs == self.signs[k]).sum(1) >= self.matches)
        if not hit.any():
            return np.empty(0, np.int64)
        at = spans_of(self.count[self.ranks[k]], self.begin[self.ranks[k]])
        both = np.bincount(self.owners[at], minlength=len(self.sets))
        return np.flatnonzero(hit & (100 * both >= self.percent * (self.sizes + self.sizes[k] - both)))


def block_links(sets: list[np.ndarray], matches: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the sets, as many as connect those that links connect."""
    links, groups = Links(sets, matches, percent), np.arange(len(sets))
    for k in range(len(sets)):
        for x in links.near(k, groups != groups[k]):
            if groups[x] != groups[k]:
                groups[groups == groups[x]] = groups[k]
                yield k, x


def keyed_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, its rows) of batches that are sorted by the keys."""
    key, found = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        starts = runs(*columns)
        for i, j in zip(starts.tolist(), np.r_[starts, batch.num_rows][1:].tolist(), strict=True):
            own = tuple(int(c[i]) for c in columns)
            if own != key and found:
                yield key, pa.Table.from_batches(found)
                found = []
            key = own
            found.append(batch.slice(i, j - i))
    if found:
        yield key, pa.Table.from_batches(found)


def compared(cells: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """(u, v): links found in each block of cells (pivot, block, doc)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _), own in keyed_blocks(batches, ["pivot", "block"]):
            docs = own.column("doc").to_numpy()
            order = np.lexsort((docs, docs != pivot))  # the pivot first
            hashes = own.column("hashes").to_pylist()
            found = list(block_links([np.frombuffer(hashes[k], U64) for k in order], matches, percent)) if len(docs) > 1 else []
            if found:
                ends = docs[order][np.array(found)]
                yield pa.record_batch({"u": pa.array(ends[:, 0]), "v": pa.array(ends[:, 1])})

    joined = cells.join(sets, "doc").select("pivot", "block", "doc", "hashes")
    return joined.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "doc").mapInArrow(rows, "u long, v long")


def mixed_members(cells: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, known) of the members of cells of several blocks that have more than one
    component; known is a member's component so far."""
    known = cells.where("blocks > 1").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("pivot", "doc", F.coalesce("component", "doc").alias("known"))
    known = scratch.save(known, "large-cells")
    mixed = known.groupBy("pivot").agg(F.count("*").alias("n"), F.min("known").alias("least"), F.max("known").alias("most")).where("least != most").select("pivot", "n")
    return hot_join(known, scratch.save(mixed, "mixed-cells"), "pivot", "n", "doc").select("doc", "known").distinct()


def shingle_postings(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(shingle, doc, known, size, after, main): the rarest shingles of each member, as
    many as a link needs, where more than one component has them. after counts the
    member's shingles that are more frequent, main is the component that has it most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column("hashes")[k].as_py(), np.int64)
                yield pa.record_batch({"shingle": pa.array(own), "doc": pa.array(np.full(len(own), batch.column("doc")[k].as_py())), "known": pa.array(np.full(len(own), batch.column("known")[k].as_py())), "size": pa.array(np.full(len(own), len(own), np.int32))})

    every = members.join(sets, "doc").mapInArrow(rows, "shingle long, doc long, known long, size int")
    counts = every.groupBy("shingle", "known").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.sum("n").alias("n"), F.count("*").alias("components"), F.max_by("known", F.struct("n", "known")).alias("main")).where("n > 1")
    counts = scratch.save(counts, "shingle-counts")
    own = hot_join(every, counts, "shingle", "n", "doc").groupBy("doc", "known", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "components", "main"))).alias("own"))
    alone = F.col("size") - F.size("own")  # shingles that no other member has are the rarest
    prefix = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100).cast("int") + 1 - alone
    posted = own.where(prefix > 0).select("doc", "known", "size", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), prefix)).alias("k", "x"))
    return posted.where("x.components > 1").select(F.col("x.shingle").alias("shingle"), "doc", "known", "size", (F.col("size") - F.col("alone") - F.col("k") - 1).alias("after"), F.col("x.main").alias("main"))


def candidate_pairs(postings: DataFrame, percent: int, block_classes: int) -> DataFrame:
    """(u, v): pairs of different components that share a posting and may link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in keyed_blocks(batches, ["shingle", "block"]):
            doc, known, size, after, home, minor = (own.column(c).to_numpy() for c in ("doc", "known", "size", "after", "home", "minor"))
            x = {c: v[home] for c, v in (("doc", doc), ("known", known), ("size", size), ("after", after))}
            for k in np.flatnonzero(minor):
                both = size[k] + x["size"]
                least = -(-percent * both // (100 + percent))  # shingles that a link shares
                may = (x["known"] != known[k]) & (1 + np.minimum(x["after"], after[k]) >= least)
                if may.any():
                    yield pa.record_batch({"u": pa.array(np.minimum(x["doc"][may], doc[k])), "v": pa.array(np.maximum(x["doc"][may], doc[k]))})

    sized = with_totals(postings, "shingle", {"n": (F.sum, F.lit(1))}, "doc").withColumn("blocks", F.ceil(F.col("n") / block_classes).cast("int")).withColumn("minor", F.col("known") != F.col("main"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    places = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = sized.withColumn("own", own).withColumn("block", F.explode(places)).select("shingle", "block", "doc", "known", "size", "after", "minor", (F.col("own") == F.col("block")).alias("home"))
    return dealt.repartition("shingle", "block").sortWithinPartitions("shingle", "block").mapInArrow(rows, "u long, v long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs whose full sets link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("one", "two"))
            good = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(one, two, strict=True)):
                a, b = np.frombuffer(a, U64), np.frombuffer(b, U64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[k] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["u", "v"]).filter(pa.array(good))

    pairs = scratch.save(pairs, "candidates")
    for end, name in (("u", "one"), ("v", "two")):
        counted = pairs.groupBy(end).agg(F.count("*").alias("n")).join(sets.select(F.col("doc").alias(end), F.col("hashes").alias(name)), end)
        pairs = hot_join(pairs, scratch.save(counted, f"sets-{name}"), end, "n", "v" if end == "u" else "u").drop("n")
    return pairs.select("u", "v", "one", "two").mapInArrow(rows, "u long, v long")


def sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(doc, hashes) of the documents whose ids members holds in column doc."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            hashes, counts = shingle_sets(texts, size)
            ends = np.cumsum(counts)
            yield pa.record_batch({"doc": pa.array(ids, pa.int64()), "hashes": pa.array([hashes[i:j].tobytes() for i, j in zip(ends - counts, ends, strict=True)], pa.binary())})

    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    return doc_texts(docs).join(wanted, "doc_id", "left_semi").mapInArrow(rows, "doc long, hashes binary")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES, block_bytes: int = BLOCK_BYTES, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Texts without words are in no class but their own. Rows that share a doc_id are one
    node, whatever their texts. A null doc_id has no component (null) and is kept. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    all_signed = scratch.save(signed(docs, size), "signed")
    ids = scratch.save(all_signed.drop("signature"), "ids")
    classes = scratch.save(all_signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")), "signed-classes")
    scratch.drop("signed")
    postings = scratch.save(prefix_postings(classes, scratch, matches), "postings")
    classes = scratch.save(classes.drop("signature"), "classes")
    scratch.drop("signed-classes", "frequent-values")
    cells = scratch.save(pivot_cells(postings, classes.groupBy("doc").agg(F.max("n").alias("n")), scratch, block_bytes, block_classes), "cells")
    scratch.drop("postings", "pivots")
    sets = scratch.save(sets_of(docs, cells, size), "sets")
    links = scratch.save(compared(cells, sets, matches, percent), "links")
    joined = components(links, scratch, "round")
    members = scratch.save(mixed_members(cells, joined, scratch), "members")
    if not members.isEmpty():
        postings = scratch.save(shingle_postings(members, sets, scratch, percent), "shingle-postings")
        more = scratch.save(confirmed(candidate_pairs(postings, percent, block_classes), sets, scratch, percent), "more-links")
        joined = components(links.unionByName(more), scratch, "last-round")
    scratch.drop("cells", "sets", "large-cells", "mixed-cells", "members", "shingle-counts", "shingle-postings", "candidates", "sets-one", "sets-two")
    with_set = ids.where("n_shingles > 0 and doc_id is not null")
    of_class = classes.select("h1", "h2", "doc").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("h1", "h2", F.coalesce("component", "doc").alias("component_id"))
    told = with_set.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    alone = ids.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


#: The same by brute force, for tables of a few thousand documents.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, place) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN edges ON place = x
), least AS (SELECT doc_id, min(place) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
