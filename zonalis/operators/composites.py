"""Composite scores and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.operators.ranking import share_below, with_ranks
from zonalis.operators.spatial import sums_within


@dataclass(frozen=True)
class Indicator:
    """One indicator of a category: its column, scale and which end is worse.

    ``sat`` (start, half): 0 at start, 50 at start + half, towards 100. ``abs`` (low, high): clamped line.
    ``max``: the value over its maximum.
    """

    category: str
    column: str
    sat: tuple[float, float] | None = None
    abs: tuple[float, float] | None = None
    max: float | None = None
    worse: str = "higher"


def scaled_exposure(value: Column, i: Indicator) -> Column:
    """Exposure 0 to 100 on the indicator's own scale."""
    if i.sat:
        start, half = i.sat
        if half == 0 or (half > 0) != (i.worse == "higher"):
            raise ValueError(f"{i.column}: scale {i.sat} runs against worse={i.worse}")
        return (1 - F.pow(F.lit(0.5), F.greatest((value - start) / half, F.when(value.isNotNull(), F.lit(0.0))))) * 100
    if i.abs:
        low, high = i.abs
        if low == high or (high > low) != (i.worse == "higher"):
            raise ValueError(f"{i.column}: scale {i.abs} runs against worse={i.worse}")
        return F.when(value.isNotNull(), F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 100)
    return value / i.max * 100


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the values present; NULL if none is."""
    present = F.array_compact(F.array(*columns))
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def composite_score(df: DataFrame, indicators: Sequence[Indicator], required: str, labels: Mapping[str, str], alert_at: float = 90.0, method: str = "absolute") -> DataFrame:
    """Adds one intensity per category, ``score`` = 100 - their mean, and ``alerts``.

    ``positional`` takes each indicator's share of rows strictly below, ``absolute`` its own scale. The score
    needs the required category; alerts name categories with any exposure at ``alert_at`` or more.
    """
    out, exposures = df, {}
    for n, i in enumerate(indicators):
        name = f"__e{n}"
        if method == "positional" and i.max is None:
            signed = F.col(i.column) if i.worse == "higher" else -F.col(i.column)
            out = with_ranks(out.withColumn("__v", signed), "__v", **{name: share_below()}).drop("__v")
        else:
            out = out.withColumn(name, scaled_exposure(F.col(i.column), i))
        exposures.setdefault(i.category, []).append(F.col(name))
    out = out.withColumns({c: row_mean(es) for c, es in exposures.items()})
    score = F.when(F.col(required).isNotNull(), 100 - row_mean([F.col(c) for c in exposures]))
    hits = [F.when(F.coalesce(F.greatest(*es) if len(es) > 1 else es[0], F.lit(-1.0)) >= alert_at, F.lit(labels[c])) for c, es in exposures.items()]
    alerts = F.nullif(F.array_join(F.array_compact(F.array(*hits)), ", "), F.lit(""))
    return out.withColumns({"score": score, "alerts": alerts}).drop(*[f"__e{n}" for n in range(len(indicators))])


def register_count(flags: Sequence[Column], present: Column) -> Column:
    """How many registers list the area; NULL where it has no row at all."""
    return F.when(present, sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0)))


def reach(areas: DataFrame, venues: DataFrame, half: float = 15.0, limit: float = 45.0, key: str = "code") -> DataFrame:
    """``(key, reach)``: sum of weight * 0.5 ** (distance / half) within the limit, 0 without any.

    ``areas(key, x, y)``, ``venues(rx, ry, weight)`` in one planar unit. Areas of one key share the sum of them all.
    """
    return areas.select(key).join(reaches(areas, venues.select("rx", "ry", F.col("weight").alias("reach")), ["reach"], half, limit, key), key)


def reaches(areas: DataFrame, venues: DataFrame, weights: Sequence[str], half: float = 15.0, limit: float = 45.0, key: str = "code") -> DataFrame:
    """``(key, ...)``, one row a key: reach() of several ``weights`` of ``venues(rx, ry, weights...)`` in one pass."""
    fading = lambda distance: F.pow(F.lit(0.5), distance / half)
    at = sums_within(areas, venues, limit, {w: (w, fading) for w in weights})
    return areas.select(key, "x", "y").join(at, ["x", "y"], "left").groupBy(key).agg(*[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in weights])


def saturating(value: Column, anchor: float) -> Column:
    """0 to 100, 95 at the anchor."""
    return 100 * (1 - F.exp(-value / (anchor / 3)))


def distinctive(df: DataFrame, groups: Mapping[str, str], total: str, least: float = 200.0, least_quotient: float = 1.5, mixed: str = "Mixed") -> DataFrame:
    """Adds ``distinctive`` and ``quotient``: the label of the group with the highest location quotient.

    Below ``least_quotient`` the label is ``mixed`` and there is no quotient; below ``least`` in total both are
    NULL.
    """
    sums = df.agg(F.sum(total).alias("__t"), *[F.sum(g).alias(f"__n_{g}") for g in groups])
    quotient = {g: F.try_divide(F.try_divide(F.col(g), F.col(total)), F.try_divide(F.col(f"__n_{g}"), F.col("__t"))) for g in groups}
    items = [F.struct(F.coalesce(q, F.lit(0.0)).alias("q"), F.lit(-n).alias("n"), F.lit(label).alias("label")) for n, ((g, label), q) in enumerate(zip(groups.items(), quotient.values()))]
    best = F.array_max(F.array(*items))
    enough = F.col(total) >= least
    out = df.crossJoin(F.broadcast(sums)).withColumn("__b", best)
    label = F.when(enough, F.when(F.col("__b.q") >= least_quotient, F.col("__b.label")).otherwise(F.lit(mixed)))
    value = F.when(enough & (F.col("__b.q") >= least_quotient), F.bround("__b.q", 2))
    return out.withColumns({"distinctive": label, "quotient": value}).drop("__t", "__b", *[f"__n_{g}" for g in groups])


def named_positions(marks: DataFrame) -> DataFrame:
    """``(name, x)`` from ``marks(name, party, wave, x)``: mean over parties of the mean over waves."""
    per = marks.where("x is not null").groupBy("name", "party").agg(F.avg("x").alias("x"))
    return per.groupBy("name").agg(F.avg("x").alias("x"))


def vote_index(votes: DataFrame, positions: DataFrame, blocs: Mapping[str, Sequence[str]], key: str = "code") -> DataFrame:
    """Vote-weighted mean position, spread, placed votes, bloc and unplaced shares per area.

    ``votes(key, opt, votes)``, ``positions(opt, x)``; an option without position is unplaced.
    """
    placed = votes.join(positions, "opt", "left")
    n = F.sum(F.when(F.col("x").isNotNull(), F.col("votes")))
    sx = F.sum(F.col("votes") * F.col("x"))
    sxx = F.sum(F.col("votes") * F.col("x") * F.col("x"))
    cast = F.sum("votes")
    mean = F.try_divide(sx, n)
    spread = F.sqrt(F.greatest(F.try_divide(sxx, n) - mean * mean, F.when(n.isNotNull(), F.lit(0.0))))
    shares = [F.try_divide(100.0 * F.sum(F.when(F.col("opt").isin(*members), F.col("votes")).otherwise(0)), cast).alias(bloc) for bloc, members in blocs.items()]
    unplaced = F.try_divide(100.0 * F.sum(F.when(F.col("x").isNull(), F.col("votes")).otherwise(0)), cast)
    return placed.groupBy(key).agg(mean.alias("mean"), spread.alias("spread"), n.alias("n"), cast.alias("cast"), *shares, unplaced.alias("unplaced"))


def shrunk_to_group(df: DataFrame, group: str, value: str, n: str, noise: str) -> DataFrame:
    """Adds ``index``: the value shrunk to its group's weighted mean by its noise.

    Between-variance is the group's sample variance less its mean noise, a tenth of the variance at least; a
    group of one keeps its own.
    """
    rows = df.where(F.col(value).isNotNull())
    per = rows.groupBy(group).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("__prior"), F.var_samp(value).alias("__var"), F.avg(noise).alias("__noise"))
    tau = F.greatest(F.col("__var") - F.col("__noise"), 0.1 * F.col("__var"))
    w = F.coalesce(F.try_divide(tau, tau + F.col(noise)), F.lit(1.0))
    return rows.join(per, group).withColumn("index", w * F.col(value) + (1 - w) * F.col("__prior")).drop("__prior", "__var", "__noise")


def smoothed_factor(a: Column, b: Column, k: float) -> Column:
    """(a + k) / (b + k)."""
    return (a + k) / (b + k)


def break_class(value: Column, breaks: Sequence[float]) -> Column:
    """Number of breaks at or below the value; NULL for NULL."""
    return F.when(value.isNotNull(), sum((F.when(value >= b, 1).otherwise(0) for b in breaks), F.lit(0)))


def bed_totals(rooms: Column, beds: Column, pitches: Column, second_homes: Column, annual: Column) -> dict[str, Column]:
    """Bookable and seasonal beds by fixed coefficients."""
    bookable = rooms * 2 + beds + pitches * 3
    seasonal = second_homes * 5 + annual * 3
    return {"bookable": bookable, "seasonal": seasonal, "share": F.try_divide(100.0 * seasonal, bookable + seasonal)}
