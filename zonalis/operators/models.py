"""Fitted models as distributed sums with small solves on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.keys import finite_of
from zonalis.operators.ranking import average_rank, distributed_row_number, grouped_quantiles, quantiles, with_ranks
from zonalis.operators.spatial import distance, sums_within
from zonalis.runtime import cut


def neighbour_rate(areas: DataFrame, radius: float, years: int, key: str = "code", scale: float = 10_000.0, rates: Mapping[str, str] | None = None) -> DataFrame:
    """``(key, rate)``: events of the neighbours per area and year, itself excluded, 0 without neighbours.

    ``areas(key, x, y, events, area)``. ``rates`` names several columns of events in one pass: rate -> column. All areas
    of the disc are summed once a place, and those of the area's own key are taken off. Rows of one key are one area
    that lies at several places: its neighbours are those of all of them.
    """
    rates = rates or {"rate": "events"}
    own = {"__a": F.col("area"), "__k": F.lit(1), **{f"__e{i}": F.col(c) for i, c in enumerate(rates.values())}}
    sites = areas.select(F.col("x").alias("rx"), F.col("y").alias("ry"), *[c.alias(name) for name, c in own.items()])
    at = sums_within(areas, sites, radius, {name: (name, lambda d: F.lit(1)) for name in own})
    every = areas.select(key, "x", "y").join(at, ["x", "y"]).groupBy(key).agg(*[F.sum(name).alias(name) for name in own])
    mine = areas.select(key, F.col("x").alias("rx"), F.col("y").alias("ry"), *[c.alias(name) for name, c in own.items()])
    mine = areas.select(key, "x", "y").join(mine, key).where(distance() <= radius)
    mine = mine.groupBy(key).agg(*[F.sum(name).alias(f"__own{name}") for name in own])
    less = lambda name: F.col(name) - F.coalesce(F.col(f"__own{name}"), F.lit(0))
    rate = lambda i: F.when(less("__k") > 0, less(f"__e{i}") * scale / (less("__a") * years))
    sums = every.join(mine, key).select(key, *[rate(i).alias(name) for i, name in enumerate(rates)])
    return areas.select(key).join(sums, key, "left").fillna(dict.fromkeys(rates, 0.0))


def standardised(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Adds z_<column> by mean and sample deviation, and returns these (M26); NaN and infinities don't count."""
    value = {c: finite_of(df, c) for c in columns}
    row = df.agg(*[F.avg(value[c]).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(value[c]).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scales = [(row[f"m{i}"], row[f"s{i}"] or 1.0) for i in range(len(columns))]
    return df.withColumns({f"z_{c}": (value[c] - m) / s for c, (m, s) in zip(columns, scales)}), scales


def linear(terms: Sequence[Column], beta: Sequence[float]) -> Column:
    return sum((F.lit(float(b)) * t for b, t in zip(beta, terms)), F.lit(0.0))


#: Step lengths that one pass tries.
STEPS = tuple(0.5**i for i in range(10))


def _poisson_sums(rows: DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over ``rows(o, y, features...)``: the loss at each of ``points``, and Hessian and gradient at the first.

    A task returns one row of sums.
    """

    def partial(batches):
        total = 0.0
        for batch in batches:
            o, y, *f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *f])
            # A step too far overflows; its loss is then infinite, and it isn't taken.
            with np.errstate(all="ignore"):
                eta = x @ points.T + o[:, None]
                mu = np.exp(eta)
                hessian = (x * mu[:, :1]).T @ x
                total = total + np.concatenate([(mu - y[:, None] * eta).sum(axis=0), hessian.ravel(), x.T @ (y - mu[:, 0])])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    m, k = points.shape
    parts = [np.array(r["v"]) for r in rows.mapInArrow(partial, "v array<double>").collect()]
    v = np.sum(parts, axis=0) if parts else np.zeros(m + k * k + k)
    return v[:m], v[m : m + k * k].reshape(k, k), v[m + k * k :]


def fit_poisson(df: DataFrame, features: Sequence[str], y: str, exposure: str, ridge: float = 1.0, tolerance: float = 1e-9, rounds: int = 100, start: Sequence[float] | None = None) -> np.ndarray:
    """Poisson regression with log link and offset log(exposure), ridge on all but the intercept.

    Damped Newton steps: one pass of sums gives the penalised loss at every length of STEPS along the step, and the
    next system at its full length; only where a shorter one is taken, a second gives the system there. The loss is
    convex, so it falls every round and a start that overshoots does no harm. The driver solves systems of k + 1
    unknowns. Rows with a NULL or non-finite value, or no exposure, don't count. ValueError without events, where
    features depend on each other without a ridge, or if the fit does not settle in ``rounds`` rounds.
    """
    rows = df.select(F.when(F.col(exposure) > 0, F.log(exposure)).cast("double").alias("__o"), F.col(y).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    rows = rows.where(" and ".join(f"abs(`{c}`) < double('infinity')" for c in rows.columns)).cache()
    k = len(features) + 1
    penalty = np.array([0.0] + [ridge] * len(features))

    def at(points: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Losses at the points, and the Newton step at the first."""
        losses, hessian, gradient = _poisson_sums(rows, np.array(points))
        losses = np.where(np.isfinite(losses), losses + [0.5 * penalty @ p**2 for p in points], np.inf)
        try:
            step = np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * points[0]) if np.isfinite(hessian).all() else np.full(k, np.nan)
        except np.linalg.LinAlgError:
            step = np.full(k, np.nan)
        return losses, step

    try:
        total = rows.agg(F.sum("__y").alias("y"), F.sum(F.exp("__o")).alias("x")).first()
        if not total["y"] or total["y"] <= 0:
            raise ValueError("the fit has no events")
        null = np.zeros(k)
        null[0] = np.log(total["y"] / total["x"])
        losses, step = at([null])
        beta, loss = null, losses[0]
        if start is not None:
            beta = np.asarray(start, float)
            losses, step = at([beta])
            while not losses[0] <= loss and np.abs(beta - null).max() > tolerance:
                # A start worse than the model without features moves towards it.
                beta = null + (beta - null) / 4
                losses, step = at([beta])
            loss = losses[0]
        for _ in range(rounds):
            if not np.isfinite(step).all():
                raise ValueError("the fit has no finite step: features that depend on each other need a ridge")
            if np.abs(step).max() < tolerance:
                return beta + step
            points = [beta + t * step for t in STEPS]
            tried, ahead = at(points)
            # Below the rounding of the sums a full step counts as falling.
            if tried[0] <= loss + 1e-11 * (abs(loss) + 1):
                beta, loss, step = points[0], tried[0], ahead
                continue
            best = int(np.argmin(tried))
            if tried[best] >= loss:
                step = step * STEPS[-1]
                continue
            beta, loss = points[best], tried[best]
            step = at([beta])[1]
        raise ValueError(f"the fit did not settle in {rounds} rounds")
    finally:
        rows.unpersist()


def with_prediction(df: DataFrame, features: Sequence[str], beta: np.ndarray, exposure: str) -> DataFrame:
    """Adds rate and expected = rate * exposure."""
    rate = F.exp(linear([F.lit(1.0), *[F.col(f) for f in features]], beta))
    return df.withColumn("rate", rate).withColumn("expected", F.col("rate") * F.col(exposure))


def dispersion(predicted: DataFrame, y: str, parameters: int) -> DataFrame:
    """Pearson dispersion; one row."""
    d = F.col(y) - F.col("expected")
    return predicted.agg((F.sum(d * d / F.col("expected")) / (F.count("*") - parameters)).alias("dispersion"))


def auc(df: DataFrame, score: str, hit: str) -> DataFrame:
    """Chance that a hit outranks a miss, ties half; one row."""
    ranked = with_ranks(df.select(score, hit), score, __r=average_rank())
    n1, n0 = F.sum(F.col(hit).cast("double")), F.sum(1 - F.col(hit).cast("double"))
    return ranked.agg(((F.sum(F.when(F.col(hit), F.col("__r"))) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def top_capture(df: DataFrame, score: str, count: str, key: str, share: float = 0.1) -> DataFrame:
    """Share of all counts among the top rows by score; one row."""
    rows = distributed_row_number(df.select(score, count, key), [F.col(score).desc(), F.col(key)], "__rn")
    most = F.greatest(F.lit(1), F.rint(F.col("__n") * share))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n"))))
    return rows.agg(F.try_divide(F.sum(F.when(F.col("__rn") <= most, F.col(count))), F.sum(count)).alias("capture"))


def season_quality(areas: DataFrame, hits: DataFrame, scores: Sequence[str], best: str, share: float = 0.1, key: str = "code", season: str = "year") -> DataFrame:
    """``(season, hit, auc_<score>..., capture)`` of seasons that the fit has not seen.

    ``areas(key, scores)``, ``hits(key, season, n)``. An area with a count above 0 is hit; ``capture`` is the share of
    the hit areas among those whose ``best`` reaches its ``1 - share`` quantile. Areas rank once for all seasons.
    """
    ranked = areas.select(key, *scores)
    for score in scores:
        ranked = with_ranks(ranked, score, **{f"__r_{score}": average_rank()})
    edge = quantiles(areas, [best], [1 - share]).select(F.col("q")[0].alias("__edge"))
    whole = areas.agg(F.count("*").alias("__all")).crossJoin(F.broadcast(edge))
    hit = hits.where("n > 0").select(key, season).distinct().join(ranked, key).crossJoin(F.broadcast(whole))
    n1 = F.count("*")
    n0 = F.first("__all") - n1
    aucs = [F.try_divide(F.sum(f"__r_{score}") - n1 * (n1 + 1) / 2, n1 * n0).alias(f"auc_{score}") for score in scores]
    return hit.groupBy(season).agg(n1.alias("hit"), *aucs, (F.count_if(F.col(best) >= F.col("__edge")) / n1).alias("capture"))


def _ols(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    b = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return F.try_divide(sy - b * sx, n), b


def cross_validated_line(df: DataFrame, keys: Sequence[str], x: str, y: str, fold: Column) -> tuple[DataFrame, DataFrame]:
    """Line y = a + b x per group with out-of-fold errors.

    Returns ``(keys, a, b, n, rmse, rmse_far)`` and the rows with ``error``. Each fold's fit is the group's sums
    less the fold's, so one pass of sums gives every fit. ``rmse_far`` takes rows with abs(x) > 0.3.
    """
    rows = df.withColumns({"__f": fold, "__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")}).where("__x is not null and __y is not null")
    per = cut(rows.groupBy(*keys, "__f").agg(F.count("*").cast("double").alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"), F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__x") * F.col("__y")).alias("sxy")))
    names = ("n", "sx", "sy", "sxx", "sxy")
    total = per.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    a, b = _ols(*[F.col(f"t_{c}") for c in names])
    held_a, held_b = _ols(*[F.col(f"t_{c}") - F.col(c) for c in names])
    folds = per.join(total, list(keys)) if keys else per.crossJoin(F.broadcast(total))
    folds = folds.select(*keys, "__f", held_a.alias("__a"), held_b.alias("__b"))
    judged = rows.join(folds, [*keys, "__f"]).withColumn("error", F.col("__y") - (F.col("__a") + F.col("__b") * F.col("__x")))
    square = F.col("error") * F.col("error")
    quality = judged.groupBy(*keys).agg(F.sqrt(F.avg(square)).alias("rmse"), F.sqrt(F.avg(F.when(F.abs("__x") > 0.3, square))).alias("rmse_far"))
    fits = total.select(*keys, a.alias("a"), b.alias("b"), F.col("t_n").cast("bigint").alias("n"))
    fits = fits.join(quality, list(keys)) if keys else fits.crossJoin(quality)
    return fits, judged.drop("__f", "__x", "__y", "__a", "__b")


def monthly_factors(df: DataFrame, observed: str, grid: str, least: float = 0.5, month: str = "month") -> DataFrame:
    """Median of observed over grid by month where the grid has enough."""
    ratio = F.when(F.col(grid) >= least, F.col(observed) / F.col(grid))
    rows = df.select(month, ratio.alias("ratio"))
    medians = grouped_quantiles(rows, [month], "ratio", [0.5]).select(month, F.col("q")[0].alias("factor"))
    return rows.groupBy(month).agg(F.count("ratio").alias("n")).join(medians, month, "left").select(month, "factor", "n")


def error_summary(df: DataFrame, keys: Sequence[str], error: str, observed: str) -> DataFrame:
    """``(keys, bias, mae, rmse, median_relative)``: bias, mean and root mean square error, median relative error."""
    e = F.col(error)
    means = df.groupBy(*keys).agg(F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    relative = df.select(*keys, F.when(F.col(observed) != 0, F.abs(e / F.col(observed))).alias("relative"))
    medians = grouped_quantiles(relative, keys, "relative", [0.5]).select(*keys, F.col("q")[0].alias("median_relative"))
    return means.join(medians, list(keys), "left")
