"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").where("v != m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node that has a link; component is its smallest node.

    links has columns u and v, long. Alternates large-star and small-star rounds until
    every node is linked with its component alone; each round is a table in scratch, so
    a lost executor repeats one round at most. Loops and repeated links are allowed.
    """
    state = scratch.save(links.where("u != v").select("u", "v").distinct(), f"{name}-0")
    told, k = None, 0
    while True:
        k += 1
        state = scratch.save(_small_star(_large_star(state)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == told:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        told = now
