"""Exact quantiles of groups by ranges, and values that are none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.functions import keys as K
from zonalis.operators import ranking as R
from zonalis.operators import stats as S


def test_grouped_quantiles_equal_numpy(spark):
    """One group holds most rows and lies in several ranges; ties, lone values, NULL keys, NaN and empty groups."""
    rng = np.random.default_rng(4)
    rows = [("city", 1, float(v)) for v in rng.normal(size=3000)] + [("town", 1, float(v)) for v in rng.integers(0, 3, 50)] + [("town", 2, 5.0), (None, 1, 7.0), (None, 1, 9.0), (None, None, 1.0)]
    rows += [(f"g{i}", i % 3, float(i)) for i in range(300)] + [("none", 1, None), ("none", 1, float("nan")), ("city", 1, float("inf")), ("city", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(5)
    got = {(r["a"], r["b"]): (r["n"], r["q"]) for r in R.grouped_quantiles(df, ["a", "b"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    groups = {}
    for a, b, v in rows:
        if v is not None and np.isfinite(v):
            groups.setdefault((a, b), []).append(v)
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, [0.0, 0.5, 0.9, 1.0]), atol=1e-12)
    assert R.grouped_quantiles(df.where("a = 'none'"), ["a"], "v", [0.5]).count() == 0
    assert R.grouped_quantiles(df.where("b = 9"), ["a"], "v", [0.5]).count() == 0


def test_statistics_of_a_table_with_nan_are_those_without(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0), (3.0, 6.0), (4.0, 9.0)]
    clean = spark.createDataFrame(rows, "x double, y double")
    planted = spark.createDataFrame([*rows, (nan, 3.0), (5.0, nan), (inf, 1.0), (2.0, -inf), (nan, inf)], "x double, y double")
    for of in (S.pearson, S.spearman):
        a, b = of(clean, "x", "y").first(), of(planted, "x", "y").first()
        assert a["n"] == b["n"] == 3 and all(abs(u - v) < 1e-12 for u, v in zip(a[1:], b[1:]))
    assert abs(S.pearson(planted, "x", "y").first()["r"] - np.corrcoef([1, 3, 4], [2, 6, 9])[0, 1]) < 1e-12
    assert S.gap(planted, "x", "y").count() == 3
    one = R.quantiles(planted, ["x"], [0.5]).first()
    assert (one["n"], one["hi"], one["q"]) == (5, 5.0, [3.0])
    ranks = [r["m"] for r in R.with_ranks(planted, "x", m=R.average_rank()).orderBy("x").collect()]
    assert sorted(r for r in ranks if r is not None) == [1, 2, 3, 4, 5] and ranks.count(None) == 3


@pytest.mark.parametrize("text, value", [("1,5 %", 1.5), ("NaN", None), ("inf", None), ("-Infinity", None), ("", None), ("7", 7.0)])
def test_numbers_are_finite(spark, text, value):
    assert spark.range(1).select(K.number(F.lit(text)).alias("v")).first()["v"] == value
