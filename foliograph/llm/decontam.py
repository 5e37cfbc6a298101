"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become lower-cased runs of letters and digits. Fixed masks
pick some positions of a window of tokens and ignore the others; the hashes of what is
picked are joined between documents and items. A hit fixes how an item lies on a
document; the whole item is then compared there token by token, so substituted tokens
lower the overlap and don't hide it. Of hits on neighbouring tokens the first of each 32
lays the item and stands for the others, so a copy of n tokens costs about n * n / 32
rows and not n * n. An overlap is half of an item at one place, or
11 of 13 tokens around a hit, however long the item, or half of it in pieces at places
not further apart than its length, as inserted and deleted tokens leave it. Nothing but
DataFrame functions.

Seeds of a benchmark of at most ``broadcast_bytes`` (counted first) are broadcast and
documents don't move at all. A larger benchmark is joined by a shuffle of the document
seeds; hits then find their texts and items again by keys of whole rows. Both ways give
the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Token positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 4, 6, 9), (0, 2, 3, 5, 9, 10))
#: Least share of an item's tokens, and least number of them, that make an overlap.
SHARE, LEAST = 0.5, 8
#: Tokens of a window around a hit, and how many of them may differ, that make one too.
WINDOW, CHANGED = 13, 2
BROADCAST_BYTES = 64 << 20


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the tokens of a text; a null text has none."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...], at: str) -> DataFrame:
    """A row for each position and mask of the token hashes in column h."""
    h, i, n = F.col("h"), F.col(at), F.size("h")
    least = min(m[-1] for m in masks)
    rows = rows.select("*", F.explode(F.when(n > least, F.sequence(F.lit(0), n - 1 - least))).alias(at))
    of = [F.when(i + m[-1] < n, F.xxhash64(F.lit(k), *[F.get(h, i + o) for o in m])) for k, m in enumerate(masks)]
    return rows.select("*", F.posexplode(F.array(*of)).alias("mask", "seed")).where("seed is not null")


def _is_hit(t: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """Whether one of the masks finds the item's token t at the row's place.

    Written as functions of arrays, which stay out of generated code and keep it small.
    """
    at = t + F.col("place")
    equal = lambda o: F.coalesce(F.get("item", t + o) == F.get("h", at + o), F.lit(False))
    return F.exists(F.array(*[F.array(*map(F.lit, m)) for m in masks]), lambda m: F.forall(m, equal))


def _told_before(mask: tuple[int, ...]) -> Column:
    """Whether the first mask finds the hit's token too, or the one before in its 32.

    That hit stands for this one. Generated code of the join, so most hits never leave it.
    """
    i, j = F.col("i"), F.col("j")

    def found(back: int) -> Column:
        out = F.lit(True)
        for o in mask:
            out = out & F.coalesce(F.get("item", j + (o - back)) == F.get("h", i + (o - back)), F.lit(False))
        return out

    return ((F.col("mask") > 0) & found(0)) | ((j % 32 != 0) & found(1))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, share: float = SHARE, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, place, matched, item_tokens): verified overlaps, one of a pair.

    place is the document token on which the item's first token lies; of several the
    one with most matched tokens, then the first. matched counts that place; where only
    the pieces of several places together make the overlap, it counts the item's tokens
    in all of them. Items with fewer tokens than a mask spans have no seeds and match
    nothing, as do null or empty texts; of rows that share a doc_id (or an item_id) each
    counts by its own text, and the best is told; a null doc_id or item_id is a value
    like others; empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("h")).where(F.size("h") > 0).distinct().withColumn("item_key", F.xxhash64(F.col("item_id").isNull(), "item_id", "h"))
    # the number, always true, keeps filters from moving below the hashes and doubling them
    texts = docs.select(F.when(F.monotonically_increasing_id() >= 0, row_key()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), token_hashes(F.col("text")).alias("h"))
    seeds = _seeds(items, masks, "j").select("seed", "mask", "item_id", "item_key", "j", F.col("h").alias("item"))
    size = items.agg(F.sum(F.size("h") * (8 * len(masks) * F.size("h") + 64 * len(masks)))).first()[0] or 0
    found = _seeds(texts, masks, "i")
    columns = ["row", "doc_id", "item_id", "item_key", "j", "place", "item", "h"]
    if size <= broadcast_bytes:
        met = found.drop("mask").join(F.broadcast(seeds), "seed").where(~_told_before(masks[0]))
        # the number, always true again, keeps what follows out of the join
        hits = met.withColumn("place", F.when(F.monotonically_increasing_id() >= 0, F.col("i") - F.col("j"))).select(*columns)
    else:
        places = found.select("row", "i", "seed").join(seeds.select("seed", "item_key", "j"), "seed").groupBy("row", "item_key", (F.col("i") - F.col("j")).alias("place")).agg(F.collect_set("j").alias("js"))
        once = texts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"))
        first = F.filter("js", lambda j: (j % 32 == 0) | ~F.array_contains("js", j - 1))
        hits = places.join(items.withColumnRenamed("h", "item"), "item_key").join(once, "row").withColumn("j", F.explode(first)).select(*columns)
    block = F.floor(F.col("j") / 32).cast("int")
    hits = hits.withColumn("block", block)
    beyond = F.filter(F.sequence(F.col("j") + 1, 32 * F.col("block") + 32), lambda t: (t == 32 * F.col("block") + 32) | ~_is_hit(t, masks))
    hits = hits.withColumn("last", F.get(beyond, F.lit(0)) - 1)
    # every token of the item at every run of hits, added up at once: no text leaves its task
    laid = hits.select(*columns, "block", "last", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("k"))
    at = F.col("k") + F.col("place")
    equal = (at >= 0) & F.coalesce(F.get("item", F.col("k")) == F.get("h", F.greatest(at, F.lit(0))), F.lit(False))
    laid = laid.select("row", "doc_id", "item_id", "item_key", "place", "j", "last", "block", "k", F.size("item").cast("long").alias("item_tokens"), equal.cast("long").alias("equal"))
    # hits of 32 item positions share a bitmap of the equal tokens in the windows around them
    before = WINDOW - 1 - min(m[-1] for m in masks)
    near = F.col("k").between(F.col("j") - before, F.col("last") + WINDOW - 1)
    bit = F.when(near, F.call_function("shiftleft", F.col("equal"), F.col("k") - 32 * F.col("block") + before)).otherwise(F.lit(0).cast("long"))
    told = laid.groupBy("row", "doc_id", "item_id", "item_key", "place", "item_tokens", "block").agg((F.sum("equal") * F.col("item_tokens") / F.count("*")).cast("long").alias("matched"), F.bit_or(bit).alias("bits"))
    half = lambda n: (n >= F.lit(share) * F.col("item_tokens")) & (n >= least)
    window = F.exists(F.sequence(F.lit(0), F.lit(31 + before)), lambda t: F.bit_count(F.call_function("shiftright", F.col("bits"), t).bitwiseAND(F.lit((1 << WINDOW) - 1))) >= WINDOW - CHANGED)
    place = F.struct("matched", (-F.col("place")).alias("back"))
    told = told.select("*", place.alias("any"), F.when(half(F.col("matched")) | window, place).alias("single"))
    # pieces of least tokens meet in stretches of two item lengths, each place in two of them
    stretch = F.floor(F.col("place") / F.col("item_tokens"))
    low = F.lit((1 << 32) - 1)
    right = lambda n: F.shiftrightunsigned("bits", n)
    parts = [F.shiftleft(F.col("bits").bitwiseAND(F.lit((1 << before) - 1).cast("long")), 32 - before), right(before).bitwiseAND(low), right(32 + before)]
    pieces = F.array(*[F.struct((stretch + d).alias("stretch"), (F.col("block") + b).alias("block"), F.when(F.bit_count("bits") >= least, x).otherwise(F.lit(0).cast("long")).alias("bits")) for d in (0, 1) for b, x in zip((-1, 0, 1), parts, strict=True)])
    pair = ["row", "doc_id", "item_id", "item_key", "item_tokens", "stretch"]
    met = told.select(*pair[:-1], "any", "single", F.explode(pieces).alias("p")).select(*pair[:-1], "any", "single", "p.*")
    met = met.groupBy(*pair, "block").agg(F.bit_or("bits").alias("bits"), F.max("any").alias("any"), F.max("single").alias("single"))
    met = met.groupBy(*pair).agg(F.sum(F.bit_count("bits")).cast("long").alias("joined"), F.max("any").alias("any"), F.max("single").alias("single"))
    met = met.where(F.col("single").isNotNull() | half(F.col("joined")))
    alone = F.col("single").isNotNull()
    x = F.struct(alone.alias("alone"), F.when(alone, F.col("single.matched")).otherwise(F.col("joined")).alias("matched"), F.coalesce("single.back", "any.back").alias("back"), "item_tokens")
    best = met.groupBy("doc_id", "item_id").agg(F.max(x).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).cast("long").alias("place"), "x.matched", "x.item_tokens")


def row_key() -> Column:
    """A number for each pair of doc_id and text, null or not."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings: object) -> DataFrame:
    """The rows of docs that overlap with no item, each by its own text."""
    row = unused(docs, "row")
    gone = contaminated(docs.select(row_key().alias("doc_id"), "text"), benchmark, **settings).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, row_key()).join(gone, row, "left_anti").select(*docs.columns)


def contaminated_sql(masks: tuple[tuple[int, ...], ...] = MASKS, share: float = SHARE, least: int = LEAST) -> str:
    """Overlaps of half an item at one place in SQL (no windows or pieces), the picked tokens themselves in place of their hashes."""
    seeds = {
        at: " UNION ALL ".join(f"SELECT {key}, {at}, w, '{k}:' || " + " || ' ' || ".join(f"w[{at} + {o + 1}]" for o in m) + f" AS seed FROM {at}s WHERE {at} + {m[-1]} < len(w)" for k, m in enumerate(masks))
        for at, key in (("i", "doc_id"), ("j", "item_id"))
    }
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
), b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark
), "is" AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), js AS (SELECT item_id, w, unnest(range(len(w))) AS j FROM b
), x AS ({seeds["i"].replace("FROM is", 'FROM "is"')}), y AS ({seeds["j"]}
), hits AS (SELECT DISTINCT doc_id, item_id, i - j AS place, x.w AS dw, y.w AS iw FROM x JOIN y USING (seed)
), told AS (SELECT doc_id, item_id, place, len(iw) AS item_tokens, len(list_filter(range(greatest(0, -place), least(len(iw), len(dw) - place)), lambda k: iw[k + 1] = dw[k + place + 1])) AS matched FROM hits
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, place) AS nth FROM told WHERE matched >= {share} * item_tokens AND matched >= {least})
SELECT doc_id, item_id, place, matched, item_tokens FROM best WHERE nth = 1
"""
