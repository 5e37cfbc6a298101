"""What the operators of this subpackage share: inputs, scratch tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space and \t \n \v \f \r (as Java and Python regex).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) and nothing else, so extra columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def smallest_hashes(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hashes of the columns.

    Rows are counted first and a range of hashes that a quarter more than ``limit`` of
    them should have is kept, so tasks hand on few rows each, however many there are.
    """
    own, n = F.xxhash64(*columns), df.count()
    if n > 2 * limit:
        df = df.where(own < -(1 << 63) + int((1 << 64) * 1.25 * limit / n))
    return df.orderBy(own, *columns).limit(limit)


def with_totals(rows: DataFrame, key: str, totals: dict[str, tuple[Callable, Column]], spread: str, salts: int = 64) -> DataFrame:
    """rows with totals of their key, such as {"n": (F.sum, F.col("size"))}.

    Totals are made for each key and salt (of column spread) and then for each key, and
    rows meet them by key and salt, so a key that a third of all rows share is dealt to
    ``salts`` tasks. Functions must be their own merge, as sum, min and max are.
    """
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)))
    parts = salted.groupBy(key, "salt_").agg(*[f(c).alias(n) for n, (f, c) in totals.items()])
    whole = parts.groupBy(key).agg(*[f(n).alias(n) for n, (f, _) in totals.items()])
    return salted.join(parts.select(key, "salt_").join(whole, key), [key, "salt_"]).drop("salt_")


def hot_join(rows: DataFrame, counted: DataFrame, key: str, n: str, spread: str, share: int = 1000, salts: int = 64) -> DataFrame:
    """rows joined with counted, which has a row a key and in column n its rows.

    At most ``share`` keys can have more than a ``share``-th of all rows each. Those are
    broadcast and dealt to ``salts`` tasks by column spread, with their row of counted
    in each, so a key that a third of all rows share stops no task. counted is read
    three times: save it first.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total / share
    keys = counted.where(hot).select(key, F.lit(True).alias("hot_"))
    dealt = rows.join(F.broadcast(keys), key, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("hot_")
    copies = counted.withColumn("salt_", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "salt_"]).drop("salt_")


class Scratch:
    """Intermediate tables in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Only a local session may leave
    that unset and then uses a temporary folder. A table written here cuts the lineage:
    when an executor is lost, later jobs reread it.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            root = f"file://{tempfile.gettempdir()}"
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it reread."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        self._remove(*(self.path(name) for name in names))

    def remove(self) -> None:
        """Remove all tables."""
        self._remove(self.root)

    def _remove(self, *paths: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
