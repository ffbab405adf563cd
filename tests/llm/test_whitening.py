"""Whitening against dense eigenvectors, and on awkward rows."""

import math

import numpy as np
import pytest

from zonalis.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n map<string,int>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", {"a": 1}) for i, v in vectors], SCHEMA)


def whitened(df, components=8):
    return whitening.whiten(whitening.entries(df), components)


def brute(vectors, k=8):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * np.float64(np.float32(c))) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = x.astype(float) - sums.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in kept], n, deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(rows, want, k):
    ids, n, deviation, white, explained = want
    rows = sorted(rows, key=lambda r: (r["component"], str(r["vec_id"])))
    order = sorted(range(len(ids)), key=lambda j: str(ids[j]))
    assert len(rows) == len(ids) * k
    for c in range(k):
        part = rows[c * len(ids) : (c + 1) * len(ids)]
        assert [r["vec_id"] for r in part] == [ids[j] for j in order]
        assert [int(r["deviation"]) for r in part] == [deviation[j] for j in order]
        a, b = np.array([r["whitened"] for r in part]), white[order, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert {r["n"] for r in part} == {n} and all(abs(r["explained"] / explained[c] - 1) < 1e-10 and r["identity_error"] < 1e-9 for r in part)


def test_embeddings_equal_dense_eigenvectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    compare(whitened(df).collect(), brute(vectors), 8)


def test_partial_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(c) for c in rng.standard_normal(5) * [5, 4, 3, 2, 1]]) for i in range(200)]
    rows = whitening.entries(frame(spark, vectors)).repartition(9)
    compare(whitening.whiten(rows, 3).collect(), brute(vectors, 3), 3)


@pytest.mark.parametrize("spectrum", ["falling", "flat", "tied", "low rank"])
@pytest.mark.parametrize("d", [3, 40, 150])
def test_leading_pairs(spectrum, d):
    rng = np.random.default_rng(d)
    e = {"falling": np.geomspace(1e4, 1, d), "flat": 100 + rng.random(d), "tied": np.r_[[9.0, 9.0, 9.0], np.ones(d - 3)], "low rank": np.r_[[4.0, 2.0], np.zeros(d - 2)]}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.leading_pairs(lambda u: a @ u, d, 8)
    want = np.sort(e)[::-1][: min(8, d)]
    want = want[want > 1e-12 * want[0]]
    assert np.allclose(values, want, rtol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_minres_solves_a_projected_system():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a @ a.T
    off = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    right = rng.standard_normal((30, 2))
    away = np.eye(30) - off @ off.T
    shift = np.array([0.5, 40.0])
    t = whitening.minres(lambda u: a @ u, shift, right, off, 60)
    for j in range(2):
        left = away @ (a - shift[j] * np.eye(30)) @ away @ t[:, j]
        assert np.abs(left - away @ right[:, j]).max() < 0.01 * np.abs(right[:, j]).max()


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(4)]) for i in range(30)]
    vectors = [*good, good[0], (None, good[1][1]), (50, None), (51, [1.0, None, 0.0, 0.0]), (52, [1.0, float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0, 0.0])]
    compare(whitened(frame(spark, vectors)).collect(), brute(vectors, 4), 4)
    # Vectors of another length have no covariance with the rest.
    assert whitened(frame(spark, [*good, (60, [1.0, 2.0]), (61, [])])).count() == 30 * 4
    assert whitened(frame(spark, vectors).where("vec_id = -1")).count() == 0
    assert whitened(frame(spark, [(1, good[0][1])])).count() == 0 and whitened(frame(spark, [(i, good[0][1]) for i in range(9)])).count() == 0
    assert whitened(frame(spark, [(1, []), (2, [])])).count() == 0


def test_deviations_beyond_a_long_stay_exact(spark):
    vectors = [(i, [float(np.float32(1e9 * (i % 7))), float(np.float32(7e8 * (i % 5)))]) for i in range(300)]
    compare(whitened(frame(spark, vectors)).collect(), brute(vectors, 2), 2)
