"""Ranks without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.keys import finite, finite_of
from zonalis.runtime import cut, shuffle_partitions


def distributed_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Adds 1, 2, 3, ... in ``order`` over the whole frame.

    Rows are dealt to ranges of the order and numbered within each; the ranges' row counts, one number per
    partition, shift them. No task sees more than its range. Ties are numbered in any order.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)
    within = ranged.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    offsets = _offsets(ranged.groupBy("__part").agg(F.count("*").alias("__n")))
    return within.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__at") + F.col("__before")).cast("bigint")).drop("__part", "__at", "__n", "__before")


def _offsets(counts: DataFrame) -> DataFrame:
    """Running total before each partition; one row per partition, so a single window task is bounded by their number."""
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__before", before)


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in ``column``; NaN and infinities are none."""
    return df.where(finite_of(df, column).isNotNull())


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """``(value, cnt, before, total)`` of each distinct value (NULL, NaN and infinities are none): how often it occurs, how many rows are smaller.

    Distinct values have no ties, so a range partitioning of the counts yields every rank rule: mid-rank
    percentile, average rank, first position, share strictly below.
    """
    spark = df.sparkSession
    counts = present(df, column).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    ranged = cut(counts.repartitionByRange(shuffle_partitions(spark), "value").withColumn("__part", F.spark_partition_id()))
    over = W.partitionBy("__part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    within = ranged.withColumn("__in", F.coalesce(F.sum("cnt").over(over), F.lit(0)))
    offsets = _offsets(ranged.groupBy("__part").agg(F.sum("cnt").alias("__n")))
    total = ranged.agg(F.sum("cnt").alias("total"))
    out = within.join(F.broadcast(offsets), "__part").crossJoin(F.broadcast(total))
    return out.select("value", "cnt", (F.col("__in") + F.col("__before")).alias("before"), "total")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``(column, n, lo, hi, q)`` of each numeric column that has a value: ``q`` are its exact quantiles, interpolated.

    Distinct values are counted, dealt to ranges of (column, value) and numbered there, so no task holds a column's
    values and nothing grows with them but the ranges.
    """
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("value")) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("cnt"))
    ranged = cut(counts.repartitionByRange(shuffle_partitions(spark), "column", "value").withColumn("__part", F.spark_partition_id()))
    over = W.partitionBy("__part", "column").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    within = ranged.withColumn("__in", F.coalesce(F.sum("cnt").over(over), F.lit(0)))
    # One row per column and partition at most.
    sums = ranged.groupBy("column", "__part").agg(F.sum("cnt").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.partitionBy("column").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"__before": earlier, "__total": F.sum("__n").over(W.partitionBy("column"))}).drop("__n")
    placed = within.join(F.broadcast(sums), ["column", "__part"]).withColumn("__at", F.col("__in") + F.col("__before"))
    picks = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("__total") - 1)
        for end in (F.floor(place), F.ceil(place)):
            picks.append(F.max(F.when((F.col("__at") <= end) & (end < F.col("__at") + F.col("cnt")), F.col("value"))))
    names = [f"__q{i}" for i in range(len(picks))]
    row = placed.groupBy("column").agg(F.sum("cnt").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), *[p.alias(n) for p, n in zip(picks, names)])

    def at(i: int) -> Column:
        place = F.lit(float(shares[i])) * (F.col("n") - 1)
        low, high = F.col(names[2 * i]), F.col(names[2 * i + 1])
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return row.select("column", "n", "lo", "hi", F.array(*[at(i) for i in range(len(shares))]).alias("q"))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """``(keys, n, q)`` of each group with a value in ``column``: the count and the exact quantiles, interpolated.

    Distinct values are counted and dealt to ranges of (group, value), so a group of any size is several tasks' work and
    none holds its values. A group that lies in one range is numbered there; of the others there are two rows a range at
    most, which go to every task. NULL, NaN and infinite values are none; NULL keys are a group.
    """
    spark = df.sparkSession
    rows = df.select(*keys, finite(F.col(column).cast("double")).alias("__v")).where("__v is not null")
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__k"))
    ranged = cut(counts.repartitionByRange(shuffle_partitions(spark), *keys, "__v").withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__part").agg(F.sum("__k").alias("__s"))
    # A part's first and last group may go on in its neighbours, no other one can.
    edge = W.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in keys])
    back = W.partitionBy("__part").orderBy(*[F.col(c).desc_nulls_last() for c in keys])
    ends = cut(sums.withColumns({"__a": F.row_number().over(edge), "__z": F.row_number().over(back)}).where("__a = 1 or __z = 1"))
    own = W.partitionBy(*keys)
    parts = ends.withColumns({"__of": F.count("*").over(own), "__total": F.sum("__s").over(own), "__before": F.coalesce(F.sum("__s").over(own.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    parts = parts.where("__of > 1").select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], "__total", "__before")
    here = W.partitionBy("__part", *keys)
    placed = ranged.withColumns({"__in": F.coalesce(F.sum("__k").over(here.orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "__own": F.sum("__k").over(here)})
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    placed = placed.join(F.broadcast(parts), same, "left")
    placed = placed.select(*keys, "__v", "__k", (F.col("__in") + F.coalesce("__before", F.lit(0))).alias("__at"), F.coalesce("__total", "__own").alias("__n"))
    picks = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("__n") - 1)
        picks += [(F.col("__at") <= end) & (end < F.col("__at") + F.col("__k")) for end in (F.floor(place), F.ceil(place))]
    some = picks[0]
    for p in picks[1:]:
        some = some | p
    # At most two rows a share and group travel on.
    row = placed.where(some).groupBy(*keys).agg(F.max("__n").alias("n"), *[F.max(F.when(p, F.col("__v"))).alias(f"__q{i}") for i, p in enumerate(picks)])

    def at(i: int) -> Column:
        place = F.lit(float(shares[i])) * (F.col("n") - 1)
        low, high = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return row.select(*keys, "n", F.array(*[at(i) for i in range(len(shares))]).alias("q"))


def with_ranks(df: DataFrame, column: str, **rules: Column) -> DataFrame:
    """Adds rank columns computed from ``cnt``, ``before`` and ``total``; rows without a value have NULL ranks."""
    ranks = value_ranks(df, column).withColumnRenamed("value", "__value")
    joined = df.join(ranks, F.col(column) == F.col("__value"), "left")
    return joined.withColumns(rules).drop("__value", "cnt", "before", "total")


def mid_percentile() -> Column:
    """Average position of the ties, plus a half, over n."""
    return (F.col("before") + (F.col("cnt") - 1) / 2.0 + 0.5) / F.col("total")


def average_rank() -> Column:
    return F.col("before") + (F.col("cnt") + 1) / 2.0


def first_rank() -> Column:
    return F.col("before") + 1


def share_below() -> Column:
    """Share strictly below, times 100, over n - 1; NULL for a single value."""
    return F.when(F.col("total") > 1, 100.0 * F.col("before") / (F.col("total") - 1))


def group_position(df: DataFrame, column: str, group: str, weight: str) -> DataFrame:
    """``(group, position, n)``: weighted mean position (share_below) of a group's rows among all."""
    ranked = with_ranks(present(df, column), column, __b=share_below())
    return ranked.groupBy(group).agg((F.sum(F.col("__b") * F.col(weight)) / F.sum(weight)).alias("position"), F.count("*").alias("n"))


def running(value: Column, keys: Sequence[str], order: str) -> Column:
    """Aggregate of a group's rows up to each one (W6); a group's rows go to one task."""
    return value.over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def consecutive(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    """Adds the next row's ``column`` within the group; last rows go."""
    return df.withColumn(name, F.lead(column).over(W.partitionBy(*keys).orderBy(order))).where(F.col(name).isNotNull())


def fold(key: Column, folds: int = 10) -> Column:
    """A row's fold by its number."""
    return F.pmod(key, F.lit(folds))


def top_share(df: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """``(key, column, share)``: the ``k`` largest rows, ties by key, and their percentage of the whole."""
    rows = present(df, column).select(key, column)
    top = rows.orderBy(F.col(column).desc(), key).limit(k)
    whole, part = rows.agg(F.sum(column).alias("__w")), top.agg(F.sum(column).alias("__p"))
    out = top.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(part))
    return out.select(key, column, (100 * F.col("__p") / F.col("__w")).alias("share"))


def movers(df: DataFrame, a: str, b: str, key: str, k: int, digits: int = 6) -> DataFrame:
    """``(key, move)``: the ``k`` rows whose positions by two columns differ most, ties by key."""
    both = present(present(df, a), b).select(key, a, b)
    ranked = with_ranks(with_ranks(both, a, __a=share_below()), b, __b=share_below())
    return ranked.select(key, F.round(F.col("__a") - F.col("__b"), digits).alias("move")).orderBy(F.abs("move").desc(), key).limit(k)


def position_profile(df: DataFrame, column: str, shares: Sequence[float], cuts: tuple[float, float] = (90.0, 10.0)) -> DataFrame:
    """``(q, high, low)``, one row: quantiles of the positions, and how many rows stand at or above and below the cuts."""
    ranked = with_ranks(present(df, column), column, __b=share_below())
    one = ranked.agg(F.count_if(F.col("__b") >= cuts[0]).alias("high"), F.count_if(F.col("__b") < cuts[1]).alias("low"))
    return quantiles(ranked, ["__b"], shares).select("q").crossJoin(F.broadcast(one))
