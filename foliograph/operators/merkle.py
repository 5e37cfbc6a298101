"""Merkle hashes and cross-document deduplication of linked objects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Children's digests that are hashed together.
CHUNK = 4096


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, content: Column, name: str = "digest") -> DataFrame:
    """Hash each parent over its own content and its children's digests, sorted.

    children: (parent_key, digest). A parent without children hashes its content alone,
    one with up to CHUNK children the content and their digests. Those of a parent with
    more are numbered in order, hashed in chunks, and the chunks' digests once more, so
    no task gathers all children of a parent. with_all_children doesn't go by chunks.
    """
    w = Window.partitionBy(parent_key, "range_").orderBy("digest")
    counts = children.groupBy(parent_key, F.substring("digest", 1, 2).alias("range_")).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(parent_key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(parent_key, "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    numbered = children.withColumn("range_", F.substring("digest", 1, 2)).withColumn("nth_", F.row_number().over(w) - 1).join(starts, [parent_key, "range_"])
    chunk = F.floor((F.col("start_") + F.col("nth_")) / CHUNK).alias("chunk_")
    chunks = numbered.groupBy(parent_key, chunk).agg(F.array_join(F.sort_array(F.collect_list("digest")), "").alias("text_"))
    last = chunks.groupBy(parent_key).agg(F.count(F.lit(1)).alias("chunks_"), F.max_by("text_", "chunk_").alias("only_"), F.transform(F.sort_array(F.collect_list(F.struct("chunk_", F.sha2("text_", 256).alias("digest")))), lambda x: x["digest"]).alias("digests_"))
    kids = last.select(parent_key, F.when(F.col("chunks_") == 1, F.col("only_")).otherwise(F.array_join("digests_", "")).alias("kids_"))
    return parents.join(kids, parent_key, "left").withColumn(name, F.sha2(F.concat(content, F.lit("|"), F.coalesce("kids_", F.lit(""))), 256)).drop("kids_")


def _hashed(batches: Iterator[pa.RecordBatch], columns: list[str], name: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, then parents before children, then by text."""

    def told(rows: pa.StructArray, digests: list[str | None]) -> pa.RecordBatch:
        return pa.record_batch([*rows.flatten(), pa.array(digests, pa.string())], [*columns, name])

    last, held, states = None, None, []  # parents of a key that may go on: rows of earlier batches, what is hashed
    for batch in batches:
        keys, kinds, n = batch.column("key_"), batch.column("kind_").to_numpy(), batch.num_rows
        if not n:
            continue
        text = batch.column("text_").cast(pa.large_string())
        absent = text.is_null().to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1].tolist()
        data = memoryview(text.buffers()[2] or b"")
        new = np.r_[keys[0].as_py() != last, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]
        starts = np.flatnonzero(new | np.r_[True, kinds[1:] != kinds[:-1]])
        own, done, digests = [], [], []
        for i, j, kind, other in zip(starts.tolist(), [*starts[1:].tolist(), n], kinds[starts].tolist(), new[starts].tolist(), strict=True):
            if other:
                ended = [h and h.hexdigest() for h in states]
                if held is not None:
                    yield told(held, ended[: len(held)])
                done += own
                digests += ended[len(ended) - len(own) :]
                own, held, states = [], None, []
            if kind == 0:
                own += range(i, j)
                states += [None if absent[k] else hashlib.sha256(data[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
            else:
                for h in states:
                    if h:
                        h.update(data[offsets[i] : offsets[j]])
        rows = batch.column("row_")
        if done:
            yield told(rows.take(pa.array(done, pa.int64())), digests)
        if own:
            more = rows.take(pa.array(own, pa.int64()))
            held = more if held is None else pa.concat_arrays([held, more])
        last = keys[n - 1].as_py()
    if held is not None:
        yield told(held, [h and h.hexdigest() for h in states])


def with_all_children(parents: DataFrame, children: DataFrame, parent_key: str, content: Column, name: str = "digest") -> DataFrame:
    """Hash each parent over its own content and its children's digests, sorted: one hash
    over all of them, however many there are.

    Parents and children meet in one sort and are hashed as they pass, so a task holds
    a batch of digests, not all of a parent's. A parent's hash is one task, as each step
    of it needs the last. A null content gives null; null digests don't count. Columns
    of parents travel along: pass those that are needed.
    """
    columns = [c for c in parents.columns if c != name]
    row = F.struct(*columns)
    owners = parents.select(F.col(parent_key).alias("key_"), F.lit(0).alias("kind_"), F.concat(content, F.lit("|")).alias("text_"), row.alias("row_"))
    kids = children.where(F.col(parent_key).isNotNull() & F.col("digest").isNotNull()).select(F.col(parent_key).alias("key_"), F.lit(1).alias("kind_"), F.col("digest").alias("text_"), F.lit(None).cast(owners.schema["row_"].dataType).alias("row_"))
    both = owners.where("key_ IS NOT NULL").unionByName(kids).repartition("key_").sortWithinPartitions("key_", "kind_", "text_")
    schema = T.StructType([parents.schema[c] for c in columns]).add(name, "string")
    hashed = both.mapInArrow(lambda batches: _hashed(batches, columns, name), schema)
    return hashed.unionByName(owners.where("key_ IS NULL").select("row_.*", F.sha2("text_", 256).alias(name)))


def identity_digest(doc: Column, num: Column) -> Column:
    """A digest that no content produces, for objects that are someone, not something."""
    return F.sha2(F.concat(F.lit("\0identity\0"), doc.cast("string"), F.lit("\0"), num.cast("string")), 256)


def representatives(objects: DataFrame, digest: str, number: str) -> DataFrame:
    """Add keeper: the smallest number of the rows with the same digest.

    An aggregation with map-side minimum and a join back, which skewed digests don't
    stop, as a window over the digest would.
    """
    least = objects.groupBy(digest).agg(F.min(number).alias("keeper"))
    return objects.join(least, digest)


def dedupe_stats(objects: DataFrame, number: str, size: str) -> DataFrame:
    """One row: objects merged into others, bytes saved by that, objects kept."""
    gone = F.col(number) != F.col("keeper")
    return objects.agg(F.count_if(gone).alias("merged"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("bytes_saved"), F.count_if(~gone).alias("kept"))


def rewrite_references(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Replace each dst by its number in remap (old, new); what is missing becomes null."""
    return edges.join(remap, edges.dst == remap.old, "left").select("src", F.col("new").alias("dst"))
