"""Whitening of embeddings by the leading components of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed. A product with it is one distributed pass: each task centres its rows, multiplies them
with the block and returns sums of dimensions x columns, which meet in a tree. The driver holds matrices of dimensions x
(a few dozen) columns only: the search space and its image, on which Rayleigh-Ritz gives the leading pairs; pairs whose
residual is down to rounding are locked; the others' correction equations, projected off the locked and wanted
vectors, are solved by a few MINRES steps, all of them in one pass a step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.runtime import cut

Product = Callable[[np.ndarray], np.ndarray]
#: Partial sums that one task adds up.
FAN_IN = 64


def entries(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """``(vec_id, x)``: every vector as integers floor(scale * c) + shift, as a table in the shared folder.

    Vectors that are NULL or hold NULL, NaN or infinite entries go, and those of another length than the most frequent
    one (ties: the longest), with which they have no covariance. Repeated rows and NULL ids stay; columns of other names
    are not read. Entries beyond a long's range saturate.
    """
    rows = df.select(F.col(key).alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("c"))
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = cut(rows.where(good).select("vec_id", F.transform("c", lambda c: F.floor(c * scale) + shift).alias("x")))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == usual[0]["d"]) if usual and usual[0]["d"] > 0 else rows.where("false")


def matrix(column: pa.ListArray) -> np.ndarray:
    """A batch's vectors as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


@dataclass
class Fit:
    """Row count and exact sums by dimension of the vectors, and the largest distance of an entry from the mean."""

    n: int
    sums: list[int]
    reach: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit_sums(rows: DataFrame) -> Fit | None:
    """Exact sums of ``rows(x)``; None without rows."""

    def partial(batches):
        n, sums, low, high = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            wide = np.abs(x.astype(np.float64)).max() * len(x) > 2.0**62
            part = [int(v) for v in (x.astype(object) if wide else x).sum(axis=0)]
            n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            d = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array(low), pa.array(high)], names=["i", "n", "s", "low", "high"])

    parts = rows.select("x").mapInArrow(partial, "i int, n bigint, s decimal(38,0), low bigint, high bigint")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not found:
        return None
    n = found[0]["n"]
    reach = max(max(abs(r["low"] * n - int(r["s"])), abs(r["high"] * n - int(r["s"]))) for r in found)
    return Fit(n, [int(r["s"]) for r in found], reach)


def block_sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], mean: np.ndarray) -> np.ndarray:
    """The sum of ``of(centred block)`` over all blocks of ``rows(x)``: a vector of fixed length.

    A task returns one vector; while there are more than FAN_IN, tasks add up FAN_IN of them each.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0)) - mean)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def added(batches):
        total = None
        for batch in batches:
            for v in batch.column(0).to_numpy(zero_copy_only=False):
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    parts, count = rows.select("x").mapInArrow(partial, "v array<double>"), rows.rdd.getNumPartitions()
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        parts = parts.repartition(count).mapInArrow(added, "v array<double>")
    return np.sum([np.array(r["v"]) for r in parts.collect()], axis=0)


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal columns that span ``block`` off ``against``; columns without a part of their own go."""
    out = np.zeros((len(block), 0)) if against is None else against
    first = out.shape[1]
    for v in block.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack([out, v / left])
    return out[:, first:]


def minres(product: Product, values: np.ndarray, right: np.ndarray, off: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` MINRES steps for (I - QQ')(A - value I)(I - QQ') t = right for each column, Q = ``off``: one product a
    step with all columns. A column whose Krylov space is exhausted stays as it is."""
    away = lambda b: b - off @ (off.T @ b)
    v = away(right)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    safe = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    v = v / safe(beta)
    eta, old_v, old_beta = beta.copy(), np.zeros_like(v), np.zeros_like(beta)
    c, s, old_c, old_s = (np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta))
    w, old_w, t = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    top = beta.copy()
    for _ in range(steps):
        if not live.any():
            break
        p = away(product(v) - v * values)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - old_beta * old_v
        p = away(p)
        beta = np.linalg.norm(p, axis=0)
        # The tridiagonal matrix's new column under the two rotations before, then its own.
        r3, r2 = old_s * old_beta, old_c * old_beta
        r2, r1 = c * r2 + s * alpha, c * alpha - s * r2
        rho = np.hypot(r1, beta)
        live &= rho > 1e-14 * np.abs(values)
        new_c, new_s = r1 / safe(rho), beta / safe(rho)
        new_w = (v - r3 * old_w - r2 * w) / safe(rho)
        t = np.where(live, t + new_c * eta * new_w, t)
        eta = -new_s * eta
        old_w, w, old_v = w, new_w, v
        old_c, old_s, c, s = c, s, new_c, new_s
        live &= (beta > 1e-13 * np.abs(values)) & (np.abs(eta) > 1e-3 * top)
        v, old_beta = p / safe(beta), beta
    return t


def leading_pairs(product: Product, d: int, k: int, inner: int = 4, most: int = 64, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric positive semi-definite operator, falling, and unit vectors (columns).

    ``product`` takes and returns d x columns. Fewer pairs come back where the rest of the spectrum is zero to rounding.
    An error if residuals have not come down to rounding in ``rounds`` rounds.
    """
    k = min(k, d)
    space = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, k + 4))))
    image = product(space)
    best, still = np.inf, 0
    for _ in range(rounds):
        h = space.T @ image
        values, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, y = values[order], y[:, order]
        ritz, drawn = space @ y, image @ y
        residual = drawn - ritz * values
        size = np.linalg.norm(residual, axis=0)
        if values[0] <= 0:
            return np.zeros(0), np.zeros((d, 0))
        rounding = 8 * np.finfo(float).eps * np.sqrt(d) * values[0]
        # Where residuals near rounding have stopped falling, rounding it is.
        worst = size[:k].max()
        still = still + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        enough = rounding if still < 3 else 100 * rounding
        locked = 0
        while locked < min(k, len(values)) and size[locked] <= enough:
            locked += 1
        if locked >= k or space.shape[1] >= d:
            good = values[:k] > 1e-12 * values[0]
            return values[:k][good], ritz[:, :k][:, good]
        if space.shape[1] + (k - locked) > min(most, d) and space.shape[1] > k + 4:
            keep = min(2 * k, space.shape[1])
            space, image, values = ritz[:, :keep], drawn[:, :keep], values[:keep]
        wanted = slice(locked, k)
        steps = minres(product, values[wanted], -residual[:, wanted], ritz[:, :k], inner)
        new = orthonormal(np.where(np.isfinite(steps), steps, 0.0), space)
        if not new.shape[1]:
            new = orthonormal(residual[:, wanted], space)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + space.shape[1]).standard_normal((d, k - locked)), space)
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise ValueError(f"residuals did not reach rounding in {rounds} rounds")


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive, so reruns agree."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of ``rows(vec_id, x)`` of entries().

    One row for each vector and component, from 1 by falling eigenvalue; components without variance are not there, so
    equal vectors, a single one or none give no rows. ``deviation`` is an exact decimal, sum of (n x - S)^2.
    """
    schema = "vec_id {}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    spark = rows.sparkSession
    fit = fit_sums(rows)
    if fit is None:
        return spark.createDataFrame([], schema)
    n, mean, d = fit.n, fit.mean, len(fit.sums)
    trace = block_sums(rows, lambda c: np.array([(c * c).sum()]), mean)[0] / n
    product = lambda u: block_sums(rows, lambda c: (c.T @ (c @ u)).ravel(), mean).reshape(u.shape) / n
    values, vectors = leading_pairs(product, d, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn = signed(vectors) / np.sqrt(values)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ turn
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = block_sums(rows, moments, mean) / n
    error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
    explained = values / trace
    exact = np.array(fit.sums, object if max(abs(s) for s in fit.sums) >= 2**62 else np.int64)
    narrow = exact.dtype != object and d * fit.reach**2 < 2**63 and n * (fit.reach // n + abs(max(fit.sums, key=abs)) // n + 2) < 2**62

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            w = (x - mean) @ turn
            if narrow:
                dev = pa.array(((n * x - exact) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                dev = pa.array([Decimal(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, exact))) for row in x], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), dev.take(at), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, schema)
