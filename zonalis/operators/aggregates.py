"""Grouped aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.operators.ranking import grouped_quantiles


def weighted_mean(value: Column, weight: Column) -> Column:
    """Ignores NULL values and their weights (A4)."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def complete(aggregate: Column, column: Column, expected: int) -> Column:
    """The aggregate where ``column`` has all expected values, else NULL."""
    return F.when(F.count(column) == expected, aggregate)


def sales(rows: DataFrame, wanted: Sequence[str], least_surface: float, price: tuple[float, float]) -> DataFrame:
    """``(code, kind, value, per_m2)`` of usable sales.

    A sale's rows carry its value each time: it counts once, surfaces add up. Usable is a positive value in one
    area and of one wanted kind, with enough surface and a price within bounds.
    """
    one = rows.groupBy("id_mutation").agg(
        F.max("valeur").alias("value"), F.collect_set("code").alias("codes"), F.collect_set("type_local").alias("kinds"), F.sum("surface").alias("surface")
    )
    usable = one.where((F.col("value") > 0) & (F.size("codes") == 1) & (F.size("kinds") == 1) & (F.col("surface") >= least_surface))
    out = usable.select(F.col("codes")[0].alias("code"), F.col("kinds")[0].alias("kind"), "value", (F.col("value") / F.col("surface")).alias("per_m2"))
    return out.where(F.col("kind").isin(*wanted) & F.col("per_m2").between(*price))


def sale_medians(kept: DataFrame, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """``(code, sales, q)`` of sales(): how many and the quantiles of their prices per m2 (A2, A3)."""
    q = grouped_quantiles(kept, ["code"], "per_m2", shares)
    return kept.groupBy("code").agg(F.count("*").alias("sales")).join(q.select("code", "q"), "code", "left")


def pivot_once(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """Pivot with declared values; an error where a cell has two rows."""
    twice = df.groupBy(*keys, column).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate cell {twice[0]}")
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def group_sums(groups: Mapping[str, Sequence], column: str, value: Column, masked: Column) -> list[Column]:
    """Conditional sums over code lists, NULL if any member is masked."""
    return [F.when(~F.coalesce(F.bool_or(F.when(F.col(column).isin(*codes), masked)), F.lit(False)), F.sum(F.when(F.col(column).isin(*codes), value))).alias(name) for name, codes in groups.items()]


def winner(option: Column, votes: Column, position: Column) -> Column:
    """Option with most votes, the first listed on a tie."""
    return F.max_by(option, F.struct(votes, -position))


def shift_counts(daily: DataFrame, keys: Sequence[str], value: str, step: float, shifts: Sequence[float], threshold: float) -> DataFrame:
    """Days whose shifted value reaches a threshold, for every shift, from one histogram.

    A day counts at shift s when value + s >= threshold; days are binned by the smallest shift that does it, and
    running sums over the bins give all counts at once.
    """
    first = F.ceil((F.lit(threshold) - F.col(value)) / step - 1e-9)
    binned = daily.groupBy(*keys, first.alias("bin")).agg(F.count("*").alias("n"))
    low, high = round(min(shifts) / step), round(max(shifts) / step)
    inside = binned.where(F.col("bin") <= high).withColumn("bin", F.greatest("bin", F.lit(low)))
    steps = daily.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(low), F.lit(high)).cast("array<bigint>")))
    counts = steps.join(inside.groupBy(*keys, "bin").agg(F.sum("n").alias("n")), [*keys, "bin"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return counts.select(*keys, (F.col("bin") * step).alias("shift"), running.alias("days"))


def interpolated_counts(table: DataFrame, wanted: DataFrame, keys: Sequence[str], step: float, low: float, high: float) -> DataFrame:
    """Counts at arbitrary shifts, linear between the tabulated ones and clipped at their ends."""
    at = F.least(F.greatest((F.col("shift") - low) / step, F.lit(0.0)), F.lit((high - low) / step))
    lo = F.least(F.floor(at), F.lit(round((high - low) / step) - 1))
    placed = wanted.withColumns({"__lo": lo, "__part": at - lo})
    tabled = table.select(*keys, F.rint((F.col("shift") - low) / step).cast("bigint").alias("__i"), "days")
    a = tabled.withColumnsRenamed({"__i": "__lo", "days": "__a"})
    b = tabled.withColumns({"__lo": F.col("__i") - 1}).withColumnRenamed("days", "__b").drop("__i")
    out = placed.join(a, [*keys, "__lo"]).join(b, [*keys, "__lo"])
    return out.withColumn("days", F.col("__a") * (1 - F.col("__part")) + F.col("__b") * F.col("__part")).drop("__a", "__b", "__lo", "__part")


def day_bins(daily: DataFrame, keys: Sequence[str], value: str, step: float, low: float, high: float, threshold: float) -> DataFrame:
    """``(keys, __bins)``: a group's histogram of shift_counts() as one array of at most (high - low) / step + 1 bins."""
    first = F.ceil((F.lit(threshold) - F.col(value)) / step - 1e-9)
    lo, hi = round(low / step), round(high / step)
    binned = daily.withColumn("__bin", F.greatest(first, F.lit(lo)).cast("int")).where(F.col("__bin") <= hi).groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    return binned.groupBy(*keys).agg(F.collect_list(F.struct("__bin", "__n")).alias("__bins"))


def with_days_of_bins(rows: DataFrame, shift: Column, step: float, low: float, high: float) -> DataFrame:
    """``rows`` with ``days`` in place of their day_bins(): the counts interpolated at each row's ``shift``, 0 without bins,
    NULL without a shift (A18, M34)."""
    lo, hi = round(low / step), round(high / step)
    at = F.least(F.greatest((shift - low) / step, F.lit(0.0)), F.lit((high - low) / step))
    out = rows.withColumn("__at", F.when(shift.isNotNull(), at))
    place = F.least(F.floor("__at"), F.lit(hi - lo - 1))
    upto = lambda last: F.aggregate(F.coalesce("__bins", F.array().cast("array<struct<__bin:int,__n:bigint>>")), F.lit(0).cast("bigint"), lambda n, b: n + F.when(b["__bin"] <= last, b["__n"]).otherwise(0))
    part = F.col("__at") - place
    return out.withColumn("days", upto(place + lo) * (1 - part) + upto(place + lo + 1) * part).drop("__at", "__bins")


def with_days_at_shift(rows: DataFrame, daily: DataFrame, keys: Sequence[str], value: str, shift: Column, step: float, low: float, high: float, threshold: float) -> DataFrame:
    """``rows(keys, ...)`` with ``days``: shift_counts() of ``daily`` interpolated at each row's ``shift``, 0 for keys
    without a day, NULL without a shift (A18, M34).

    A group's histogram travels as one array, so no table of all shifts is made.
    """
    bins = day_bins(daily, keys, value, step, low, high, threshold)
    return with_days_of_bins(rows.join(bins, list(keys), "left"), shift, step, low, high)


def histogram_median(df: DataFrame, keys: Sequence[str], age: str, count: str) -> DataFrame:
    """Median of single-year counts, interpolated within the year where half is reached, one decimal."""
    w = W.partitionBy(*keys).orderBy(age)
    before = F.coalesce(F.sum(count).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(count).over(W.partitionBy(*keys))
    rows = df.where(F.col(count) > 0).withColumns({"__before": before, "__half": total / 2.0})
    hit = rows.where((F.col("__before") < F.col("__half")) & (F.col("__before") + F.col(count) >= F.col("__half")))
    return hit.select(*keys, F.bround(F.col(age) + (F.col("__half") - F.col("__before")) / F.col(count), 1).alias("median"))


def described(column: str) -> list[Column]:
    """Count, mean, population deviation and extremes."""
    c = F.col(column)
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max")]


def collapsed_sequences(calls: DataFrame, trip: str = "trip") -> DataFrame:
    """Identical ordered stop lists with their trips counted and the quickest trip's times.

    ``calls(trip, product, pos, stop, minutes)``; a trip's list is bounded by its calls.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "stop", "minutes")))
    lists = calls.groupBy(trip, "product").agg(ordered.alias("c"))
    lists = lists.select(trip, "product", F.transform("c", lambda x: x["stop"]).alias("stops"), F.transform("c", lambda x: x["minutes"]).alias("times"))
    total = F.aggregate("times", F.lit(0), lambda a, x: a + x)
    return lists.groupBy("product", "stops").agg(F.count("*").alias("runs"), F.min(F.struct(total.alias("t"), F.col("times"))).alias("best")).select("product", "stops", "runs", "best.times")


def distinct_slots(rows: DataFrame, themes: Mapping[str, str], key: str = "code") -> DataFrame:
    """``(key, basket, ...)``: how many different slots are filled in all and per theme (A9). ``rows(key, theme, slot)``,
    ``themes``: theme to column name."""
    slots = rows.select(key, "theme", "slot").distinct().groupBy(key, "theme").agg(F.count("*").alias("__k"))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("theme") == t, F.col("__k"))), F.lit(0))
    return slots.groupBy(key).agg(F.sum("__k").alias("basket"), *[of(t).alias(n) for t, n in themes.items()])


def strongest(state: Column, order: Sequence[str]) -> Column:
    """The strongest state present, ``order`` naming them strongest first; others are the weakest (A10)."""
    rank = F.lit(0)
    for n, name in enumerate(reversed(order), 1):
        rank = F.when(state == name, F.lit(n)).otherwise(rank)
    return F.max_by(state, rank)


def sorted_set(value: Column, sep: str = ",") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def day_counts(days: DataFrame, restrictions: str, levels: Sequence[str], severe: int, key: str = "code") -> DataFrame:
    """``(key, days, severe, worst)`` of one row a day with an array of structs (A13): a day's level is the highest of its
    structs' ``levels``."""
    worst = F.array_max(F.transform(restrictions, lambda r: F.greatest(*[r[c] for c in levels])))
    flat = days.select(key, worst.alias("worst"))
    return flat.groupBy(key).agg(F.count("*").alias("days"), F.count_if(F.col("worst") >= severe).alias("severe"), F.max("worst").alias("worst"))


def in_months(value: Column, month: Column, months: Sequence[int]) -> Column:
    """The value in the months of a season, NULL in others."""
    return F.when(month.isin(*months), value)


def season_shares(monthly: DataFrame, key: str, value: str, months: Sequence[int]) -> DataFrame:
    """``(key, share, peak, amplitude)`` of groups with all twelve months: percentage of the months, the strongest month
    (the earlier of equals to six decimals), and the strongest over the mean (A20). ``monthly(key, month, value)``."""
    per = monthly.groupBy(key).agg(
        F.count("*").alias("__k"), F.sum(value).alias("__t"), F.sum(in_months(F.col(value), F.col("month"), months)).alias("__s"),
        F.max_by("month", F.struct(F.round(value, 6), -F.col("month"))).alias("peak"), F.max(value).alias("__m"))
    return per.where("__k = 12").select(key, (100 * F.col("__s") / F.col("__t")).alias("share"), "peak", (12 * F.col("__m") / F.col("__t")).alias("amplitude"))


def share_where(condition: Column, n: Column) -> Column:
    """Percentage of the sum of ``n`` in rows that meet a condition."""
    return 100.0 * F.sum(F.when(condition, n).otherwise(0)) / F.sum(n)


def national_profile(df: DataFrame, value: str, weight: str, column: str, shares: Sequence[float]) -> DataFrame:
    """``(national, present, q)``, one row: weighted mean of ``value``, percentage of rows with ``column`` and its exact
    quantiles (A23, A24)."""
    from zonalis.operators.ranking import quantiles

    one = df.agg(weighted_mean(F.col(value), F.col(weight)).alias("national"), (100.0 * F.count(column) / F.count("*")).alias("present"))
    return one.join(quantiles(df, [column], shares).select("q"), F.lit(True), "left")


def pair_totals(rows: DataFrame, keys: Sequence[str], weight: str, offset: Column) -> DataFrame:
    """Rows, weight and weighted offset of each pair of keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight).cast("double").alias("weight"), F.sum(F.col(weight) * offset).alias("offset"))


def measures_by_class(rows: DataFrame, by: str, area: Column, length: Column) -> DataFrame:
    """Features, area and length of each class."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(area).alias("area"), F.sum(length).alias("length"))


def threshold_days(daily: DataFrame, key: str, hit: Column) -> DataFrame:
    """``(key, days)``: mean number of days a year that meet a condition, of groups with every year of the data."""
    yearly = daily.groupBy(key, "year").agg(F.count_if(hit).alias("__d"))
    years = daily.agg(F.count_distinct("year").alias("__years"))
    per = yearly.groupBy(key).agg(F.avg("__d").alias("days"), F.count("*").alias("__n"))
    return per.crossJoin(F.broadcast(years)).where("__n = __years").select(key, "days")


def cell_mean(points: DataFrame, value: Column, size: float = 1.0, x: str = "lon", y: str = "lat") -> DataFrame:
    """``(cx, cy, mean)`` of each cell, a missing value counting 0 as sea does."""
    return points.groupBy(F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("mean"))
