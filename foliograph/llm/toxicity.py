"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts and hold passages of them. Both
hold ordinary passages; the toxic one also holds passages of toxic texts, and the
ordinary one has the same passages there without the words that tell toxic texts from
ordinary ones, so surroundings cost either dictionary the same. A text is cut into
overlapping windows of several words; each window is compressed with both dictionaries,
between fixed bytes that both hold (zstandard would store so short a block as it is).
How many bytes the toxic dictionary saves over the ordinary one is the window's
distance. Thresholds are calibrated on labelled documents that no dictionary saw: a
logistic curve over the numbers of windows whose distance reaches each of THRESHOLDS,
and over the number of windows.

Passages are chosen greedily: those with most weight of words first, each for words
that aren't covered yet. The weight is a word's significance in toxic texts, or the
logarithm of its count. Copies of one document are no evidence, so of documents with one
fingerprint only one counts.

Training uses at most ``sample`` labelled rows (the smallest hashes of ids; a documented
bound) and never the held-out ones. The sample is written once in PARTS files; each part
counts words and proposes passages, and the driver gets significant words, proposals of
at most a dictionary's size a part, and one histogram a calibration document. Scores are
a narrow pass over all documents.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_texts, smallest_hashes

#: Labelled rows that training reads at most, and files that they are written to.
SAMPLE, PARTS = 20_000, 8
#: Words in a window, and from one window's start to the next.
WINDOW, STEP = 8, 4
#: Bytes of the passages that both dictionaries hold, and of those that tell them apart.
SHARED_BYTES, OWN_BYTES = 60_000, 3_000
#: Words of a kind whose weights the driver knows at most.
WORDS = 20_000
#: Least significance of a telling word, in standard deviations.
TOXIC_Z = 5.5
#: Distances beyond this count as this; distances at which windows are counted.
FAR, THRESHOLDS = 24, (2, 3, 4, 5, 6)
THRESHOLD = 0.3
#: Windows that are compressed at once.
AT_ONCE = 20_000
PREAMBLE = b"|0123456789abcdefghijklmnopqrstuvwxyz-window-compression-length:"
#: Follows the window, as zstandard starts no match in the last bytes of a block.
CLOSING = b"~closing-bytes-of-the-window~"
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split()


def windows(text: str, window: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Overlapping windows that hold every word; the last may be shorter."""
    own = words(text)
    return [b" ".join(own[k : k + window]) for k in range(0, max(1, len(own) - window + step), step)] if own else []


def fingerprint(own: list[bytes]) -> int:
    """Equal for most near copies: the smallest hash of three words in a row."""
    return min((zlib.crc32(b" ".join(own[k : k + 3])) for k in range(max(1, len(own) - 2))), default=0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


class Distance:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes, window: int, step: int):
        self.window, self.step = window, step
        self.ordinary, self.toxic = map(self.compressor, (ordinary, toxic))

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        content = CLOSING + content + PREAMBLE
        params = zstandard.ZstdCompressionParameters.from_level(9, source_size=200, dict_size=len(content), write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=params)

    def of(self, parts: list[bytes]) -> np.ndarray:
        data = [PREAMBLE + b" " + part + b" " + CLOSING for part in parts]
        ordinary, toxic = (c.multi_compress_to_buffer(data, threads=1) for c in (self.ordinary, self.toxic))
        return np.clip([len(ordinary[k]) - len(toxic[k]) for k in range(len(data))], -FAR, FAR)

    def histograms(self, texts: list[str]) -> np.ndarray:
        """How often each distance from -FAR to FAR comes in each text."""
        counts, parts, owner = np.zeros((len(texts), 2 * FAR + 1), np.int64), [], []

        def flush() -> None:
            if parts:
                np.add.at(counts, (owner, self.of(parts) + FAR), 1)
                parts.clear()
                owner.clear()

        for k, text in enumerate(texts):
            own = windows(text, self.window, self.step)
            for at in range(0, len(own), AT_ONCE):
                parts += own[at : at + AT_ONCE]
                owner += [k] * (len(parts) - len(owner))
                if len(parts) >= AT_ONCE:
                    flush()
        flush()
        return counts


@functools.lru_cache(maxsize=2)
def distance(toxic: bytes, ordinary: bytes, window: int, step: int) -> Distance:
    """One for each worker, so that digested dictionaries outlive a task."""
    return Distance(toxic, ordinary, window, step)


def features(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the windows at each threshold and of all windows, and 1."""
    tails = [np.log1p(counts[:, FAR + t :].sum(1)) for t in THRESHOLDS]
    return np.stack([*tails, np.log1p(counts.sum(1)), np.ones(len(counts))], 1)


def calibrated(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton's method."""
    x = features(counts)
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return beta


class Model:
    """What training leaves: two dictionaries and coefficients; None without labelled
    documents of both classes, when every score is the smoothed toxic share."""

    def __init__(self, share: float, toxic: bytes = b"", ordinary: bytes = b"", beta: np.ndarray | None = None, window: int = WINDOW, step: int = STEP):
        self.share, self.toxic, self.ordinary, self.beta, self.window, self.step = share, toxic, ordinary, beta, window, step

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(texts), self.share)
        counts = distance(self.toxic, self.ordinary, self.window, self.step).histograms(texts)
        return 1 / (1 + np.exp(-np.clip(features(counts) @ self.beta, -30, 30)))


def covering(passages: Iterable[list[bytes]], weight: Callable[[bytes], float], times: int, size: int) -> list[list[bytes]]:
    """Passages of at most about ``size`` bytes: those with most weight first, each for
    a word that fewer than ``times`` chosen ones have."""
    rated = {b" ".join(p): (sum(weight(w) for w in set(p)), p) for p in passages}
    used, out, total = Counter(), [], 0
    for text, (score, p) in sorted(rated.items(), key=lambda x: (-x[1][0], x[0])):
        if score <= 0 or total >= size:
            break
        if any(weight(w) > 0 and used[w] < times for w in p):
            out.append(p)
            total += len(text) + 1
            used.update(set(p))
    return out


def dictionaries(toxic: Iterable[list[bytes]], ordinary: Iterable[list[bytes]], telling: dict[bytes, float], common: dict[bytes, float]) -> tuple[bytes, bytes]:
    """The contents of the toxic and of the ordinary dictionary."""
    own = covering(toxic, lambda w: telling.get(w, 0.0), 2, OWN_BYTES)
    shared = covering(ordinary, lambda w: common.get(w, 0.0), 1, SHARED_BYTES)
    with_words = b" ".join(b" ".join(p) for p in own)
    without = b" ".join(b" ".join(w for w in p if w not in telling) for p in own).ljust(len(with_words))
    both = b" " + b" ".join(b" ".join(p) for p in shared) + b" "
    return with_words + both, without + both


def _passages(own: list[bytes], window: int) -> Iterator[list[bytes]]:
    return (own[k : k + window] for k in range(0, len(own), window))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, window: int = WINDOW, step: int = STEP) -> Model:
    """Dictionaries from ids with remainder 0 or 1, calibration from remainder 3."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", remainder).where("fold != 2")
    chosen = smallest_hashes(told, sample, "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = doc_texts(docs).where("doc_id is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "fold", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.save(texts.repartition(PARTS, "doc_id"), "sample")
    try:
        return _trained(texts, scratch, window, step)
    finally:
        scratch.remove()


def _trained(texts: DataFrame, scratch: Scratch, window: int, step: int) -> Model:
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(words(t)) for t in batch.column(2).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "toxic": batch.column(1), "mark": pa.array(marks, pa.int64())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that have each word, by class; the empty word counts documents."""
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update({b"", *words(text)})
        every = list(seen[0] | seen[1])
        yield pa.record_batch({"word": pa.array(every, pa.binary()), "ordinary": pa.array([seen[0][w] for w in every], pa.int64()), "toxic": pa.array([seen[1][w] for w in every], pa.int64())})

    learn = texts.where("fold != 3")
    one = learn.select("doc_id", "toxic", "text").mapInArrow(marked, "doc_id long, toxic int, mark long").groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    learn = scratch.save(learn.join(F.broadcast(one), "doc_id", "left_semi").select("toxic", "text"), "learn")  # at most ``sample`` ids
    counts = learn.mapInArrow(counted, "word binary, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    counts = scratch.save(counts, "words")
    total = counts.where(F.length("word") == 0).first()
    good, bad = (total["ordinary"], total["toxic"]) if total else (0, 0)
    share = (bad + 1) / (good + bad + 10)
    if not good or not bad:
        return Model(share)
    p, n = F.lit(bad / (good + bad)), F.col("ordinary") + F.col("toxic")
    rated = counts.where("length(word) between 1 and 64").select("word", n.alias("n"), "toxic", ((F.col("toxic") - n * p) / F.sqrt(n * p * (1 - p))).alias("z"))
    telling = {bytes(r["word"]): r["z"] for r in rated.where((F.col("z") > TOXIC_Z) & (F.col("toxic") > 1)).orderBy(F.col("z").desc(), "word").limit(WORDS).collect()}
    common = {bytes(r["word"]): math.log(r["n"]) for r in rated.where("n > 2").orderBy(F.col("n").desc(), "word").limit(WORDS + len(telling)).collect() if bytes(r["word"]) not in telling}

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's own choice of toxic and of ordinary passages."""
        found: tuple[list, list] = ([], [])
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for passage in _passages(words(text), window):
                    if any(w in telling for w in passage) == (toxic > 0):
                        found[toxic > 0].append(passage)
        best = covering(found[1], lambda w: telling.get(w, 0.0), 2, OWN_BYTES), covering(found[0], lambda w: common.get(w, 0.0), 1, SHARED_BYTES)
        yield pa.record_batch({"toxic": pa.array([k == 0 for k, x in enumerate(best) for _ in x], pa.bool_()), "passage": pa.array([b" ".join(x) for own in best for x in own], pa.binary())})

    passages = learn.mapInArrow(proposed, "toxic boolean, passage binary").collect()
    split = [[bytes(r["passage"]).split() for r in passages if r["toxic"] is kind] for kind in (True, False)]
    toxic, ordinary = dictionaries(*split, telling, common)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = distance(toxic, ordinary, window, step)
        for batch in batches:
            rows = d.histograms(batch.column(1).to_pylist()).astype("<i8")
            yield pa.record_batch({"toxic": batch.column(0), "counts": pa.array([r.tobytes() for r in rows], pa.binary())})

    rows = texts.where("fold = 3").select("toxic", "text").mapInArrow(histograms, "toxic int, counts binary").collect()
    truth = np.array([r[0] > 0 for r in rows], float)
    if not 0 < truth.sum() < len(truth):
        return Model(share)
    beta = calibrated(np.stack([np.frombuffer(bytes(r[1]), "<i8") for r in rows]), truth)
    return Model(share, toxic, ordinary, beta, window, step)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, window: int = WINDOW, step: int = STEP, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Empty and null texts have no windows and get the curve's value there. Repeated rows
    score alike, a null doc_id is not held out, and an empty table gives no rows. Whole
    texts are scored, long ones in slices. Labels with a null in either column teach
    nothing; of contrary labels the toxic one counts.
    """
    model = train(docs, labels, sample, window, step)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(model.scores([t or "" for t in batch.column(1).to_pylist()]))})

    scored = doc_texts(docs).mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
