"""Order: natural sort keys, numbering, siblings, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def natural_key(name: Column) -> Column:
    """A string whose plain order is the natural order of names.

    Digit runs compare by value (any length below 10,000 digits), then fewer leading
    zeros first; letters A-Z compare without case; ties are left to the name itself.
    A run becomes 0, the length of its value, the value and the run's length, so it
    sorts against other characters as a digit does.
    """
    parts = F.regexp_extract_all(F.translate(F.coalesce(name, F.lit("")), _UPPER, _LOWER), F.lit("([0-9]+|[^0-9])"), 0)

    def part(p: Column) -> Column:
        value = F.regexp_replace(p, "^0+", "")
        run = F.concat(F.lit("0"), F.lpad(F.length(value).cast("string"), 4, "0"), value, F.lpad(F.length(p).cast("string"), 4, "0"))
        return F.when(p.rlike("^[0-9]"), run).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def natural_rank(df: DataFrame, name: str, group: list[str] | None = None) -> DataFrame:
    """Add rank, from 1, of the distinct names of each group in natural order."""
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("natural", name)
    return df.withColumn("natural", natural_key(F.col(name))).withColumn("rank", F.dense_rank().over(w).cast("long")).drop("natural")


def siblings(df: DataFrame, parent: str, order: str, node: str) -> DataFrame:
    """Add the previous and next sibling of each node."""
    w = Window.partitionBy(parent).orderBy(order)
    return df.withColumns({"prev": F.lag(node).over(w), "next": F.lead(node).over(w)})


def first_appearance(df: DataFrame, key: list[str], out_no: str) -> DataFrame:
    """Add target: the first output number of the same key, where references go."""
    return df.withColumn("target", F.min(out_no).over(Window.partitionBy(*key)))


def renumbered(df: DataFrame, order: str, name: str = "new_no", parts: int | None = None) -> DataFrame:
    """Add dense numbers from 1 in order (nulls first), without one task that sees all rows.

    Rows are range-partitioned once and saved with the number of their partition, so what
    is counted and what is numbered are the same. Partitions are counted, one row each,
    and each adds the counts before it. order must be unique, of any type that sorts.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = Scratch(spark, "renumbered").save(df.repartitionByRange(parts, order).withColumn("part_", F.spark_partition_id()), "dealt")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = dealt.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start_"))
    inner = Window.partitionBy("part_").orderBy(order)
    return dealt.withColumn("nth_", F.row_number().over(inner)).join(F.broadcast(starts), "part_").withColumn(name, (F.col("start_") + F.col("nth_")).cast("long")).drop("part_", "start_", "nth_")


def running_offsets(df: DataFrame, size: str, order: str, group: list[str]) -> DataFrame:
    """Add offset: bytes before a row in its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
