"""Searches over a written token table against searches over the names."""

import pytest

from zonalis.plans import search as W

NAMES = [
    "Saint-Étienne", "Saint-Denis", "Sainte-Marie", "Ste Marie aux Mines", "Étampes", "Le Mans", "La Mansonnière", "Mans", "l'Haÿ-les-Roses", "Œuilly", "Villers-Saint-Paul", "Paul", "Saint", "", "  ",
    "Mans le Mans", "Romans-sur-Isère", "Trois-Mans", "A", "Aa",
]


@pytest.mark.parametrize("text", ["mans", "Le Mans", "st", "ste marie", "saint", "ans", "œ", "ha roses", "paul saint", "01", "0", "1A", "", "zz", "a", "s e"])
def test_token_search_equals_search(spark, tmp_path_factory, text):
    rows = spark.createDataFrame([(f"0{i}" if i % 2 else f"1A{i}", n, 100 * (i % 4)) for i, n in enumerate(NAMES)] + [("099", None, 1)], "code string, name string, population int")
    path = str(tmp_path_factory.getbasetemp() / "token-table")
    try:
        table = spark.read.parquet(path)
    except Exception:
        W.write_token_table(rows, path)
        table = spark.read.parquet(path)
    got, want = ([tuple(r[c] for c in ("code", "name", "rank", "more")) for r in how.collect()] for how in (W.search_tokens(table, text, 5), W.search(rows, text, 5)))
    assert got == want


def test_ranges_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:05d}", f"Town {chr(97 + i % 26)}{i}", i) for i in range(500)], "code string, name string, population int")
    W.write_token_table(rows, str(tmp_path / "t"))
    plan = W.search_tokens(spark.read.parquet(str(tmp_path / "t")), "q")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,q)" in plan and "LessThan(token,q" in plan
