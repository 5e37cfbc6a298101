"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS. One multinomial is fitted
on trusted documents and one on the whole corpus; a document's score is the mean log
ratio of its grams, so it doesn't depend on length. A document is kept if it passes the
base rules and its score reaches the threshold, which is a parameter.

Only DataFrame functions. The corpus counts read every document once and shuffle a row
for each bucket and task; the scores read them once more and shuffle one row for each
document. The trusted documents are a bounded sample of the labelled ones (the
``trusted`` smallest hashes of ids), so their ids can be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, smallest_hashes

BUCKETS = 1 << 14
#: At most so many trusted documents; their ids take 8 bytes each.
TRUSTED = 20_000
#: Least mean log ratio of a gram for a document that stays.
THRESHOLD = -0.05
#: Pseudo-count of each bucket, on the scale of the trusted counts: ratios of buckets
#: that are seldom met shrink towards 0.
SMOOTHING = 50.0
#: Position bits of a packed trigram; longer texts take the other way.
_AT = (1 << 24) - 1


def split_words(text: Column) -> Column:
    """The words of a text that isn't null, in order."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram_rows(hashed: DataFrame) -> DataFrame:
    """A row for each word: one (its bucket) and two (that of it and the next word).

    A text without words has one row, with nulls.
    """
    h, i = F.col("h"), F.col("i")
    rows = hashed.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)))).alias("i"))
    first = F.get(h, i)
    pair = F.when(first.isNotNull(), F.xxhash64(first, F.get(h, i + 1)))
    return rows.withColumns({"one": F.pmod(first, F.lit(BUCKETS)).cast("int"), "two": F.pmod(pair, F.lit(BUCKETS)).cast("int")}).drop("h", "i")


def log_ratios(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with the array of each bucket's log ratio, target over corpus.

    labels: (doc_id, quality). Without any trusted document all ratios are 0.
    """
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = smallest_hashes(ids, trusted, "doc_id").withColumn("target", F.lit(1))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(split_words(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("h")).join(F.broadcast(ids), "doc_id", "left").select(F.coalesce("target", F.lit(0)).alias("target"), "h")
    grams = _gram_rows(hashed).select("target", F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")])
    listed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("x"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    scale = F.col("all_good") / F.col("all_raw")
    ratio = F.transform("x", lambda b: F.log((b["good"] + smoothing) / (b["raw"] * scale + smoothing)))
    return listed.select(F.when(F.col("all_good") > 0, ratio).otherwise(F.transform("x", lambda b: F.lit(0.0))).alias("ratios"))


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from the word hashes h: words in windows of three that come twice.

    A window is packed as 40 bits of hash and 24 of position. Sorted, equal windows are
    neighbours. Where 40 bits don't tell the windows of a text apart, or positions don't
    fit, pairs of whole hash and position are sorted instead.
    """
    head, at = F.lit(~_AT).cast("long"), F.lit(_AT).cast("long")
    nothing = F.array().cast("array<int>")

    def repeated(ordered: Column, same: Callable, place: Callable) -> Column:
        def near(x: Column, k: Column) -> Column:
            after = F.coalesce(same(x, F.get(ordered, k + 1)), F.lit(False))
            return after | F.when(k > 0, same(x, F.get(ordered, k - 1))).otherwise(False)

        return F.sort_array(F.transform(F.filter(ordered, near), place))

    h, t = F.col("h"), F.col("t")
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    df = df.withColumn("t", F.when(F.size(h) >= 3, windows).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("kinds", F.size(F.array_distinct(t)))
    df = df.withColumn("short", F.when(F.col("kinds") < F.size(t), F.transform(t, lambda x, k: x.bitwiseAND(head).bitwiseOR(k.cast("long")))))
    df = df.withColumn("packs", (F.size(t) < _AT) & (F.size(F.array_distinct(F.transform("short", lambda x: x.bitwiseAND(head)))) == F.col("kinds")))
    df = df.withColumn("ordered", F.when(F.col("packs"), F.sort_array("short")))
    df = df.withColumn("pairs", F.when(F.col("short").isNotNull() & ~F.col("packs"), F.sort_array(F.transform(t, lambda x, k: F.struct(x.alias("t"), k.alias("k"))))))
    by_pack = repeated(F.col("ordered"), lambda a, b: a.bitwiseAND(head) == b.bitwiseAND(head), lambda x: x.bitwiseAND(at).cast("int"))
    by_pair = repeated(F.col("pairs"), lambda a, b: a["t"] == b["t"], lambda x: x["k"])
    df = df.withColumn("places", F.when(F.col("ordered").isNotNull(), by_pack).when(F.col("pairs").isNotNull(), by_pair).otherwise(nothing))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("places") - 1), F.lit(3).cast("long"), lambda a, k: a + F.least(F.get("places", k) - F.get("places", k - 1), F.lit(3)))
    told = F.when(F.size("places") == 0, F.lit(0).cast("long")).when(F.size("places") == 1, F.lit(3).cast("long")).otherwise(covered)
    return df.withColumn("n_repeat_words", told).drop("t", "kinds", "short", "packs", "ordered", "pairs", "places")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED, with_text_hash: bool = False) -> DataFrame:
    """One row for each row of docs: base counts, score and verdict, texts not returned.

    with_text_hash adds the text's hash, to find the row again.

    A null or empty text has no words, fails the base rules and has score 0. Repeated
    rows are judged each for itself, a null doc_id stays null, and without a trusted
    document every score is 0, so the base rules alone decide.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ratios = log_ratios(docs, labels, trusted)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), split_words(text).alias("words"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    base = base.select("row", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), word_hashes(F.col("words")).alias("h"))
    base = _with_repeated_words(base)
    w = ratios.select("ratios").scalar()
    grams = _gram_rows(base)
    gain = F.get(w, F.col("one")) + F.get(w, F.col("two"))
    kept = ["doc_id", *["text_hash"] * with_text_hash, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = grams.groupBy("row").agg(*[F.first(c).alias(c) for c in kept], F.coalesce(F.sum(gain) / (2 * F.count("one")), F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(*kept, failed.alias("base_failed"), (~failed & (F.round("score", 9) >= threshold)).alias("kept"), "score")
