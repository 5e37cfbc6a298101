"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import RENDERED_SQL, rendered
from .common import Scratch, table
from .decontam import contaminated, contaminated_sql
from .minhash import NEAR_SQL, near_duplicates
from .packing import pack_documents
from .quality import quality_rules
from .sharding import kd_shards
from .suffix import find_repeats, text_columns
from .toxicity import toxicity
from .urlfilter import JUDGED_SQL, RULES, judged
from .warc import CONVERTED_SQL, convert_pages


def tokenizer_files() -> dict[str, str]:
    """The public vocabulary that packing uses by default, wherever it is installed."""
    import public_tokenizers as files

    return {"tokenizer": str(files.path("byte_bpe_50k.json")), "ranks": str(files.path("byte_bpe_50k.tiktoken")), "pattern": files.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), **tokenizer_files())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_columns(find_repeats(table(spark, sf_dir, "documents"), min_bytes=400))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, action string")
    return judged(table(spark, sf_dir, "pages"), rules)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = convert_pages(table(spark, sf_dir, "pages"), Scratch(spark, "warc").path("archives"))
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat": op5_chat,
    "op6_sharding": op6_sharding,
    "op7_minhash": op7_minhash,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_warc": op10_warc,
}

ORACLE = {
    "op2_decontamination": contaminated_sql(),
    "op5_chat": RENDERED_SQL,
    "op7_minhash": NEAR_SQL,
    "op9_url_filter": JUDGED_SQL,
    "op10_warc": CONVERTED_SQL,
}
