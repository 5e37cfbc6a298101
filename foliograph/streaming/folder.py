"""A folder of PDF files as a stream of document rows.

The batch operators are used as they are: each micro-batch is parsed like a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pdf_tables import documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def watched_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(doc_id, content) of the files that come into a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch)
    return stream.load(folder).select(F.col("path").alias("doc_id"), "content")


def watched_documents(spark: SparkSession, folder: str, passwords: tuple[str, ...] = ()) -> DataFrame:
    """documents() of the files as they come."""
    return documents(watched_files(spark, folder), passwords)
