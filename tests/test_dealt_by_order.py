"""Line items and their orders are dealt to tasks of a bounded number of rows, with the rows of the SQL."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_queries import ORACLE, QUERIES, con, rows  # noqa: F401
from zonalis import runtime
from zonalis.operators import network
from zonalis.plans.catalogue import Views


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 500, raising=False)


@pytest.fixture
def many_partitions(spark, small_tasks):
    """More partitions than the rows need, which adaptive execution joins to one a core."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("view", ["patterns", "sale_rows", "fires"])
def test_no_task_gathers_more_rows_when_the_table_grows(spark, sf, small_tasks, view):
    per = getattr(Views(spark, sf), view).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in per.collect()) <= 1000


@pytest.mark.parametrize("name", ["w7_consecutive_hops", "a28_sequence_collapse", "u1_u2_unions", "o5_network_documents", "r7_direct_reach"])
def test_dealt_rows_equal_sql(spark, sf, con, small_tasks, name):  # noqa: F811
    df, got = QUERIES[name](spark, sf), con.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def tasks_of_orders(df):
    """Into how many tasks the plan of ``df`` deals line items by order."""
    return {int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


def test_r4_r5_r6_hops_are_found_in_bounded_tasks(spark, sf, small_tasks, monkeypatch):
    written = []
    monkeypatch.setattr(network, "cut", lambda df: written.append(tasks_of_orders(df)) or runtime.cut(df))
    QUERIES["r4_r5_r6_routed_hops"](spark, sf)
    assert written[0] and min(written[0]) >= 12


def fixed_tasks_of_orders(df):
    """As tasks_of_orders(), of exchanges alone whose number adaptive execution keeps."""
    return {int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


def test_r4_r5_r6_hops_stay_in_bounded_tasks_where_partitions_are_joined(spark, sf, many_partitions, monkeypatch):
    written = []
    monkeypatch.setattr(network, "cut", lambda df: written.append(fixed_tasks_of_orders(df)) or runtime.cut(df))
    QUERIES["r4_r5_r6_routed_hops"](spark, sf)
    assert written[0] and min(written[0]) >= 12


def test_r7_rides_stay_in_bounded_tasks_where_partitions_are_joined(spark, sf, con, many_partitions):  # noqa: F811
    df, got = QUERIES["r7_direct_reach"](spark, sf), con.execute(ORACLE["r7_direct_reach"])
    tasks = fixed_tasks_of_orders(df)
    assert tasks and min(tasks) >= 12
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_r7_rides_are_found_in_bounded_tasks(spark, sf, small_tasks):
    tasks = tasks_of_orders(QUERIES["r7_direct_reach"](spark, sf))
    assert tasks and min(tasks) >= 12


def test_o5_patterns_are_collapsed_once_and_sorted_in_bounded_tasks(spark, sf, small_tasks):
    df = QUERIES["o5_network_documents"](spark, sf)
    assert not [f for f in df.inputFiles() if f.endswith("lineitem.parquet")]
    per = df.groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in per.collect()) <= 1000
    runs = [r["runs"] for r in df.collect()]
    assert runs == sorted(runs, reverse=True)
