"""Deduplication and pinned filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order.

    A group limit (rank filter) lets Spark drop rows before the shuffle, so a hot key doesn't gather.
    """
    from pyspark.sql import Window as W

    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def keep_richest(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per key, one with ``column`` if there is any."""
    whole = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min_by(whole, F.struct(F.col(column).isNull(), F.xxhash64(*df.columns))).alias("row"))
    return best.select(*keys, "row.*")


def keep_heaviest(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """The heaviest row per key and how many there were (D3)."""
    whole = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.max_by(whole, F.struct(weight, F.xxhash64(*df.columns))).alias("row"), F.count("*").alias("doubles"))
    return best.select(*keys, "row.*", "doubles")


def pinned(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows whose columns have the given values; pushed into the scan."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == x for c, x in values.items()], F.lit(True)))


def totals_only(df: DataFrame, known: Sequence[str], total: str = "_T") -> DataFrame:
    """Pins every column outside ``known`` to its total."""
    return pinned(df, {c: total for c in df.columns if c not in known})
