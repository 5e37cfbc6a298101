"""Newest-wins and first-wins resolution of keys, filling and flag merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_wins(df: DataFrame, key: list[str], order: list[Column], live: Column | None = None) -> DataFrame:
    """The row of each key that comes last by order; dead rows don't count.

    One aggregation with a map-side maximum, so a key with many versions moves one row
    for each task. An older live row resurfaces where the newest is dead.
    """
    rows = df if live is None else df.where(live)
    others = [c for c in df.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *others)).alias("x"))
    return best.select(*key, *[f"x.{c}" for c in others]).select(*df.columns)


def first_wins_union(frames: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Union in which earlier frames beat later ones, key by key; adds source (from 0)."""
    tagged = [f.withColumn("source", F.lit(k)) for k, f in enumerate(frames)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    others = [c for c in every.columns if c not in (*key, "source")]
    best = every.groupBy(*key).agg(F.min(F.struct("source", *[o.alias(f"o{k}") for k, o in enumerate(order)], *others)).alias("x"))
    return best.select(*key, "x.source", *[f"x.{c}" for c in others])


def argmax(df: DataFrame, key: list[str], value: str, order: Column, where: Column | None = None) -> DataFrame:
    """The value at the greatest order of each group, among rows that fit."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def fill_chain(df: DataFrame, key: list[str], order: Column, columns: list[str]) -> DataFrame:
    """For each column its newest value that isn't null, so older rows fill what is missing."""
    return df.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def merge_flags(df: DataFrame, key: list[str], bits: str, flag: str, value: str, order: str) -> DataFrame:
    """Bit-or, boolean or, and the first value that isn't null in source order."""
    return df.groupBy(*key).agg(F.bit_or(bits).alias("bits"), F.bool_or(flag).alias("any_flag"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("first_value"))
