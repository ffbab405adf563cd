"""Connected components by contraction (operator R1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.runtime import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; component = smallest node reachable.

    Alternates two aggregations until nothing changes: every node and its larger neighbours point to the
    smallest neighbour, then every node and its smaller neighbours do. Both keep the graph's components and
    end in stars round the smallest node. A hub's neighbours are folded by a partial ``min`` and joined back
    by a join that AQE can split, so no node's neighbourhood is gathered in one task. Each round is cut to a
    table in the shared folder. NULL ends and self-loops are ignored.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    """Changes whenever the edge set does."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = e.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u")
    out = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
