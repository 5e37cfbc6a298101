"""A training corpus from documents: five stages, each a Parquet table for the next.

1. quality: documents that the quality rules reject go.
2. near-dedup: one document of each group of near copies stays.
3. suffix-dedup: passages that repeat are cut out of the texts.
4. decontamination: documents that overlap with a benchmark item go.
5. packing: what is left becomes pieces of token sequences.

Every stage reads all that the one before kept. All but the last return the columns of
documents. Stages 2 and 4 decide by doc_id and text together, null or not: rows with equal
both are one document from stage 2 on, rows that only share a doc_id are several; empty
tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import Scratch, table, unused
from foliograph.llm.decontam import row_key, without_contaminated
from foliograph.llm.minhash import near_duplicates
from foliograph.llm.packing import pack_documents
from foliograph.llm.quality import quality_rules
from foliograph.llm.queries import tokenizer_files
from foliograph.llm.suffix import find_repeats

#: Shortest repeat that is cut, in bytes: 51 words of two letters take more.
REPEAT_BYTES = 150


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = quality_rules(docs, table(spark, sf_dir, "labels"), with_text_hash=True)
    kept = verdicts.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    mine = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id) & (mine == kept.kept_hash), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id, then hash, of each component; one of repeated
    rows, which an aggregation picks where they are read, so that many stop no task."""
    row = unused(docs, "row")
    keyed = docs.withColumn(row, row_key())
    keys = keyed.select(F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    groups = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = keys.distinct().join(groups, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    one = keyed.groupBy(row).agg(F.min(F.struct(F.xxhash64(*docs.columns).alias("hash"), F.struct(*docs.columns).alias("own"))).alias("x"))
    return one.join(kept, row, "left_semi").select("x.own.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_repeats(docs, min_bytes=REPEAT_BYTES, whole_characters=True)
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[columns.get(c, F.col(f"extra.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, **tokenizer_files())


STAGES = [
    ("quality", quality),
    ("near-dedup", near_dedup),
    ("suffix-dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each but the last written and reread."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)  # no later stage reads it
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
