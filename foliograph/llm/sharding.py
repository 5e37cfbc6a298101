"""Shards of near-equal bytes by a k-d tree over document metadata.

A node that should become k shards is cut along the metadata dimension in which it is
widest, at the weighted median that leaves floor(k / 2) shards' bytes on the left, until
every leaf is one shard. Dimensions are the text's size and ranks of whole values.
Medians are exact and distributed: a job sums bytes in BINS bins of every open node, the
bin that holds the median is binned again, and so on; the driver sees bins, never rows.

A unit is a group of equal texts, and no unit is cut; only a group heavier than a shard
(one may hold a third of all rows) is dealt into units of a twentieth of a shard. Of the
units with the coordinate that a cut falls on, the tree may choose freely, so the LARGE
heaviest ones, whose ids the driver holds, go left as they fit, largest first, and a cut
in the others' hashes takes up the rest.

Texts are read once. Jobs run over a small table of metadata in the shared scratch
folder. Slots are numbered in blocks, so no task needs a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import renumbered
from .common import Scratch, hot_join, with_totals
from .suffix import runs

BINS = 1024
#: A cut between values may miss its median by this share of a shard's bytes, and units
#: above it are placed one by one, the heaviest so many at most.
TOLERANCE, LARGE = 0.002, 50_000
#: Units of a group that is heavier than a shard, for each shard it could fill.
SPLIT = 20
#: Rows of a shard that one task numbers.
BLOCK_ROWS = 20_000
TOP = (1 << 63) - 1


@dataclass
class Node:
    """Part of the tree; first is its first shard, large its units that are placed one
    by one."""

    first: int
    leaves: int
    large: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    cut: tuple[str, int, int] | None = None  # (dimension, value, text hash): what is below goes left
    left: Node | None = None
    right: Node | None = None


def _hash(*c: Column) -> Column:
    """63 bits, not negative."""
    return F.shiftrightunsigned(F.xxhash64(*c), 1)


def _bare(node: Node | None) -> Node | None:
    """The tree without its large units, as tasks need it."""
    return node and Node(node.first, node.leaves, cut=node.cut, left=_bare(node.left), right=_bare(node.right))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.cut is None else _leaves(node.left) + _leaves(node.right)


def _walk(node: Node, columns: dict[str, np.ndarray], rows: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, its rows) for each leaf that has rows."""
    if node.cut is None:
        if len(rows):
            yield node, rows
        return
    dim, value, text = node.cut
    d = columns[dim][rows]
    below = (d < value) | ((d == value) & (columns["th"][rows] < text))
    yield from _walk(node.left, columns, rows[below])
    yield from _walk(node.right, columns, rows[~below])


def _columns(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}


@dataclass
class _Search:
    """The search for one node's cut: the range that holds it, and bytes before that."""

    node: Node | None
    dim: str
    goal: float
    lo: int
    hi: int
    value: int | None = None  # once it's known, the search goes on in the hashes
    own: np.ndarray | None = None  # then: the large units that go left
    before: int = 0

    def bins(self, columns: dict[str, np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(bin, bytes, least value, greatest value) of those of the rows in the range."""
        if self.value is not None:
            rows = rows[columns[self.dim][rows] == self.value]
        v = columns[self.dim if self.value is None else "th"][rows]
        inside = (v >= self.lo) & (v <= self.hi)
        rows, v = rows[inside], v[inside]
        if not len(v):
            return
        width = max(1.0, (self.hi - self.lo + 1) / BINS)
        at = ((v - self.lo) / width).astype(np.int64)
        order = np.lexsort((v, at))
        at, v, size = at[order], v[order], columns["size"][rows][order]
        starts = runs(at)
        for i, j, w in zip(starts, np.r_[starts, len(at)][1:], np.add.reduceat(size, starts), strict=True):
            yield int(at[i]), int(w), int(v[i]), int(v[j - 1])

    def narrow(self, bins: list[tuple[int, int, int, int]], slack: float) -> tuple[int, float] | None:
        """(value, 0) of a cut below a value, or (value, left) if it falls into one, of
        which that many bytes go left; else None and the next range. A unit isn't cut:
        in the hashes the cut is at its nearer end."""
        for k, (_, w, lo, hi) in enumerate(bins, 1):
            if self.before + w >= self.goal or k == len(bins):
                break
            self.before += w
        over, under = self.before + w - self.goal, self.goal - self.before
        if min(over, under) <= slack or (lo == hi and self.value is not None):
            return (hi + 1 if over < under else lo), 0.0
        if lo == hi:
            return lo, under
        self.lo, self.hi = lo, hi
        return None


def _binned(rows: DataFrame, root: Node, searches: dict[int, _Search], large: dict[str, np.ndarray], names: list[str]) -> dict[int, list[tuple[int, int, int, int]]]:
    """The bins of each search, by first shard; large units count for values only."""
    tree, asked = _bare(root), {k: replace(s, node=None, own=None) for k, s in searches.items()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _columns(batch, names)
            told = [(n.first, *b) for n, own in _walk(tree, columns, np.arange(batch.num_rows)) if n.first in asked for b in asked[n.first].bins(columns, own)]
            yield pa.record_batch([pa.array([t[k] for t in told], pa.int64()) for k in range(5)], names=["node", "bin", "w", "lo", "hi"])

    parts = rows.mapInArrow(found, "node long, bin long, w long, lo long, hi long")
    told = [tuple(r) for r in parts.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()]
    told += [(first, *b) for first, s in searches.items() if s.value is None for b in s.bins(large, s.node.large)]
    out: dict[int, dict] = {first: {} for first in searches}
    for first, at, w, lo, hi in told:
        _, w0, lo0, hi0 = out[first].get(at, (at, 0, lo, hi))
        out[first][at] = (at, w0 + w, min(lo, lo0), max(hi, hi0))
    return {first: [b[k] for k in sorted(b)] for first, b in out.items()}


def fitting(sizes: np.ndarray, room: float, rest: float) -> np.ndarray:
    """A mask of the units that go left: the largest first, as they fit into the room;
    if the rest can't fill what stays, the one that comes nearest to it as well."""
    left = np.zeros(len(sizes), bool)
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] <= room:
            left[k], room = True, room - sizes[k]
    short = room - rest
    if short > 0 and not left.all():
        k = np.flatnonzero(~left)[np.argmin(abs(sizes[~left] - short))]
        left[k] = abs(sizes[k] - short) < short
    return left


def _divide(node: Node, dim: str, value: int, text: int, own: np.ndarray) -> None:
    """Cut a node; own are its large units that go left."""
    half = node.leaves // 2
    node.cut = (dim, value, text)
    node.left, node.right = Node(node.first, half, own), Node(node.first + half, node.leaves - half, np.setdiff1d(node.large, own))


def kd_tree(rows: DataFrame, dims: list[str], n_shards: int, large: dict[str, np.ndarray], tolerance: float = TOLERANCE) -> Node:
    """The tree over rows (size, th and dims, all long) and the large units (arrays of
    the same names, size being the whole unit's), which rows doesn't have."""
    root = Node(0, n_shards, np.arange(len(large["th"])))
    names, ends = ["size", "th", *dims], [f"{n}_{d}" for d in dims for n in ("lo", "hi")]
    schema = "node long, total long, " + ", ".join(f"{n} long" for n in ends)
    spread, slack = {}, 0.0
    while True:

        def stats(columns: dict[str, np.ndarray], own: np.ndarray) -> list[int]:
            return [int(x) for x in (columns["size"][own].sum(), *(f(columns[d][own]) for d in dims for f in (np.min, np.max)))]

        def found(batches: Iterator[pa.RecordBatch], root: Node = _bare(root)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = _columns(batch, names)
                told = [(n.first, *stats(columns, own)) for n, own in _walk(root, columns, np.arange(batch.num_rows))]
                yield pa.record_batch([pa.array([t[k] for t in told], pa.int64()) for k in range(2 + len(ends))], names=["node", "total", *ends])

        every = [F.sum("total").alias("total"), *[(F.min if n.startswith("lo") else F.max)(n).alias(n) for n in ends]]
        told = [tuple(r) for r in rows.mapInArrow(found, schema).groupBy("node").agg(*every).collect()]
        told += [(n.first, *stats(large, n.large)) for n in _leaves(root) if len(n.large)]
        known: dict[int, list[int]] = {}
        for first, *x in told:
            y = known.setdefault(first, [0, *x[1:]])
            known[first] = [y[0] + x[0], *(f(a, b) for f, a, b in zip([min, max] * len(dims), y[1:], x[1:], strict=True))]
        if not spread:
            if not known:
                return root
            spread = {d: max(1, known[0][2 + 2 * k] - known[0][1 + 2 * k]) for k, d in enumerate(dims)}
            slack = tolerance * known[0][0] / n_shards
        searches = {}
        for node in _leaves(root):
            if node.leaves > 1 and node.first in known:
                total, *bounds = known[node.first]
                k = max(range(len(dims)), key=lambda k: (bounds[2 * k + 1] - bounds[2 * k]) / spread[dims[k]])
                searches[node.first] = _Search(node, dims[k], total * (node.leaves // 2) / node.leaves, bounds[2 * k], bounds[2 * k + 1])
        if not searches:
            return root
        while searches:
            bins = _binned(rows, root, searches, large, names)
            again = {}
            for first, s in searches.items():
                cut = s.narrow(bins[first], slack)
                if cut is None:
                    again[first] = s
                    continue
                node, (at, left) = s.node, cut
                if s.value is not None:
                    _divide(node, s.dim, s.value, at, s.own)
                    continue
                values = large[s.dim][node.large]
                below = node.large[values < at]
                if not left:
                    _divide(node, s.dim, at, 0, below)
                    continue
                tied = node.large[values == at]
                rest = next(w for _, w, lo, hi in bins[first] if lo == hi == at) - int(large["size"][tied].sum())
                chosen = tied[fitting(large["size"][tied], left, rest)]
                own, room = np.r_[below, chosen], left - int(large["size"][chosen].sum())
                if room <= 0 or room >= rest:
                    _divide(node, s.dim, at, 0 if room <= 0 else TOP, own)
                else:
                    again[first] = _Search(node, s.dim, room, 0, TOP, at, own)
            searches = again


def placed_rows(rows: DataFrame, root: Node, large: dict[str, np.ndarray], names: list[str]) -> DataFrame:
    """rows with the shard that the tree puts them into."""
    shards = np.zeros(len(large["th"]), np.int32)
    for leaf in _leaves(root):
        shards[leaf.large] = leaf.first
    order = np.argsort(large["th"])
    known, shards, tree = large["th"][order], shards[order], _bare(root)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, shard = _columns(batch, names), np.zeros(batch.num_rows, np.int32)
            for node, own in _walk(tree, columns, np.arange(batch.num_rows)):
                shard[own] = node.first
            if len(known):
                at = np.minimum(np.searchsorted(known, columns["th"]), len(known) - 1)
                shard = np.where(known[at] == columns["th"], shards[at], shard).astype(np.int32)
            yield batch.append_column("shard", pa.array(shard))

    return rows.mapInArrow(found, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))


def ranked(rows: DataFrame, values: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """rows with column key, a hash of a value, replaced by the value's rank; values has
    the distinct values v."""
    counted = values.groupBy("v").agg(F.count("*").alias("n")).withColumn(key, F.xxhash64(F.col("v").isNull(), "v"))
    counted = scratch.save(renumbered(counted, "v", "rank").select(key, "n", "rank"), f"values-{key}")
    return hot_join(rows, counted, key, "n", "rh").drop(key, "n").withColumnRenamed("rank", key)


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source"), tolerance: float = TOLERANCE, large_units: int = LARGE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, ...) for each row.

    size is the text's UTF-8 bytes plus 16. Give n_shards, or target_bytes for as many
    shards as that takes. dims are columns of docs, besides the size, of any type that
    sorts; missing ones are left out, nulls come first, and equal texts have the least of
    their rows' values. Equal texts share a shard unless they weigh more than one. A null
    text has no bytes. A row heavier than a shard fills one alone, so others stay smaller
    or empty. Repeated rows are rows like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    named = {f"dim_{k}": F.col(f"`{d}`") for k, d in enumerate(d for d in dims if d in docs.columns)}
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _hash(text).alias("th"), _hash(doc_id, F.monotonically_increasing_id()).alias("rh"), *[F.xxhash64(c.isNull(), c).alias(n) for n, c in named.items()])
    rows = scratch.save(rows, "own-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, round(total / target_bytes))
    for n, c in named.items():
        rows = ranked(rows, docs.select(c.alias("v")), scratch, n)
    # equal texts get equal coordinates, the least of theirs, and the group's weight
    own = [F.col(n).alias(f"own_{n}") for n in named]
    shared = with_totals(rows.select(*[c for c in rows.columns if c not in named], *own), "th", {"group_bytes": (F.sum, F.col("size")), **{n: (F.min, F.col(f"own_{n}")) for n in named}}, "rh")
    units = F.ceil(F.lit(SPLIT * n_shards) * F.col("group_bytes") / F.lit(max(1, total)))
    split = F.when(F.col("group_bytes") * n_shards > F.lit(total), _hash("th", F.pmod("rh", units))).otherwise(F.col("th"))
    rows = scratch.save(shared.withColumn("th", split).withColumn("dim_size", F.col("size")).drop("group_bytes", *[f"own_{n}" for n in named]), "rows")
    dims = ["dim_size", *named]
    least = tolerance * total / n_shards
    weights = rows.groupBy("th").agg(F.sum("size").alias("size"), *[F.min(n).alias(n) for n in dims]).where(F.col("size") > least)
    heavy = weights.orderBy(F.col("size").desc(), "th").limit(large_units).collect()
    large = {c: np.array([r[c] for r in heavy], np.int64) for c in ("th", "size", *dims)}
    is_large = spark.createDataFrame([(int(h), True) for h in large["th"]], "th long, large boolean")
    small = scratch.save(rows.join(F.broadcast(is_large), "th", "left_anti").select("size", "th", *dims), "small-rows")
    tree = kd_tree(small, dims, n_shards, large, tolerance)
    placed = scratch.save(placed_rows(rows, tree, large, ["size", "th", *dims]).select("doc_id", "size", "text_crc32", "rh", "th", "shard"), "placed")
    scratch.drop("own-rows", "rows", "small-rows", *[f"values-{n}" for n in named])
    return slots(placed).drop("rh", "th")


def slots(placed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add slot, gapless from 0 in each shard, numbered in blocks of hashed ids."""
    blocks = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    dealt = placed.withColumn("block", F.pmod("rh", F.lit(max(1, -(-blocks // block_rows)))))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "block").orderBy("rh", "doc_id", "th")
    return dealt.withColumn("nth", F.row_number().over(inner) - 1).join(starts, ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("nth")).cast("long")).drop("block", "start", "nth")
