"""Sums of orders: equal orders have equal sums, whatever the order in which they are added."""

from functools import reduce
from operator import add

from zonalis.plans.catalogue import Views, queries

PRICES = [0.1, 0.2, 0.3, 0.7, 12345.67, 99999.99, 0.01, 1.1]


def orders(spark, at, prices):
    rows = [(10 * k + i, k, p) for k, ps in prices.items() for i, p in enumerate(ps)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{at}/orders.parquet")
    return str(at)


def test_sums_do_not_depend_on_order(spark, tmp_path):
    turned = {k: PRICES[k:] + PRICES[:k] for k in range(8)}
    assert len({reduce(add, p) for p in turned.values()}) > 1
    rows = Views(spark, orders(spark, tmp_path, turned)).order_sums.collect()
    assert [r["n"] for r in rows] == [8] * 8 and {r["total"] for r in rows} == {112348.07}


def test_prices_that_are_no_decimals_are_summed_as_doubles(spark, tmp_path):
    at = orders(spark, tmp_path, {1: [1e-12, 2e-12], 2: [1e300, 1.0], 3: [None, None], 4: [float("nan"), 1.0], 5: [None, 2.5]})
    got = {r["code"]: r["total"] for r in Views(spark, at).order_sums.collect()}
    assert (got["00001"], got["00002"], got["00003"], got["00005"]) == (3e-12, 1e300, None, 2.5) and got["00004"] != got["00004"]


def test_equal_spends_share_a_position(spark, tmp_path):
    """Eight areas with the same orders in another order all stand at position 0."""
    at = orders(spark, tmp_path, {k: PRICES[k:] + PRICES[:k] for k in range(8)})
    spark.createDataFrame([(k, 1, 1.0, f"c{k}") for k in range(8)], "c_custkey long, c_nationkey int, c_acctbal double, c_name string").write.parquet(f"{at}/customer.parquet")
    row = queries()["m14_position_quantiles"](spark, at).first()
    assert (row["p50"], row["high"], row["low"]) == (0.0, 0, 8)
