"""Queries against their SQL where customer keys have six digits: their first five are the code, so areas share codes."""

import os

import pytest

from tests.test_queries import ORACLE, QUERIES, rows
from zonalis.operators import spatial as S

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def wide(sf, tmp_path_factory):
    """The smallest tables three times, with customer keys 100,000 apart."""
    at = str(tmp_path_factory.mktemp("wide"))
    size = {t: duckdb.sql(f"select count(*) from '{sf}/{t}.parquet'").fetchall()[0][0] for t in ("supplier", "part", "orders")} | {"customer": 100_000}
    keys = {
        "customer": {"c_custkey": "customer"}, "supplier": {"s_suppkey": "supplier"}, "part": {"p_partkey": "part"}, "orders": {"o_orderkey": "orders", "o_custkey": "customer"},
        "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    }
    for name in sorted(f[:-8] for f in os.listdir(sf) if f.endswith(".parquet")):
        moved = ", ".join(f"({c} + i * {size[t]})::bigint as {c}" for c, t in keys.get(name, {}).items())
        columns = f"* exclude (i) replace ({moved})" if moved else "* exclude (i)"
        duckdb.sql(f"select {columns} from '{sf}/{name}.parquet', range({3 if moved else 1}) r(i)").write_parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def con(wide):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(wide):
        c.execute(f"create view {f[:-8]} as select * from '{wide}/{f}'")
    return c


SHARED = [
    "p13_employment",
    "p15_tourist_beds",
    "p16_seasonality",
    "q9_q10_gates_and_names",
    "j10_lines_meeting_polygons",
    "j2_join_diagnostics",
    "q5_q6_rates_and_collisions",
    "j6_j7_reindex_and_remap",
    "j9_point_in_polygon",
    "m11_w4_rank_classes",
    "m13_scenario_rows",
    "m16_positional",
    "m3_m4_agreement_and_gap",
    "o2_o4_documents",
    "p25_climate_table",
    "p25_snowy_days",
    "p28_culture_reach",
    "m19_m20_reach_scores",
    "j12_within_distance",
    "j11_nearest",
    "p21_projected_heat",
    "m25_neighbour_rate",
    "m5_local_correlation",
    "m5_local_correlation_widening",
]


@pytest.mark.parametrize("name", SHARED)
def test_query_equals_sql_where_areas_share_codes(spark, wide, con, name):
    df = QUERIES[name](spark, wide)
    got = con.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_fire_model_has_one_row_a_code(spark, wide):
    codes = [r["code"] for r in QUERIES["p26_fire_model"](spark, wide).select("code").collect()]
    assert len(codes) == len(set(codes)) > 0


def test_spread_is_zero_without_placed_votes(spark, tmp_path):
    """One customer has a single vote, for an option without a position."""
    orders = spark.createDataFrame([(1, 1, "4-NOT SPECIFIED"), (2, 2, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["code"]: r["spread"] for r in QUERIES["m22_vote_index"](spark, str(tmp_path)).collect()}
    assert got == {"00001": 0.0, "00002": 0.0}


def test_drought_keeps_overseas_codes_where_told(spark):
    from zonalis.plans import area_pipelines as P

    data = [(("97101",), [(1, 0, 3)]), (("01001",), [(0, 0, 2)])]
    records = spark.createDataFrame(data, "commune struct<code: string>, restrictions array<struct<AEP: int, SOU: int, SUP: int>>")
    assert [r["code"] for r in P.drought(records).collect()] == ["01001"]
    assert {tuple(r) for r in P.drought(records, mainland=False).collect()} == {("97101", 1, 1, 3), ("01001", 1, 0, 2)}


def test_inspect_shows_one_area(spark):
    from zonalis.functions import geometry as G
    from pyspark.sql import functions as F

    from zonalis.plans import feature_pipelines as Q

    areas = spark.createDataFrame([("00002",), ("00001",)], "code string").withColumn("rings", G.square(F.lit(0.0), F.lit(0.0), 1.0))
    table = spark.createDataFrame([("00001", 5), ("00002", 6)], "code string, people int")
    fields = spark.createDataFrame([("people", "base", "People")], "field string, source string, label string")
    places = spark.createDataFrame([(1, 0.0, 0.0)], "site int, sx double, sy double")
    rows_, _ = Q.inspect((0.5, 0.5), areas, table, fields, places, 0.5)
    assert [(r["code"], r["value"]) for r in rows_.collect()] == [("00001", "5")]


def test_equal_points_stay_as_many_rows(spark):
    matched = spark.createDataFrame([("a", "P2"), ("a", "P1"), ("a", "P2"), ("a", "P1"), ("b", None), ("b", None), ("b", None)], "id string, poly string")
    assert sorted((r["id"], r["poly"] or "") for r in S.one_polygon(matched, ["id"]).collect()) == [("a", "P1")] * 2 + [("b", "")] * 3


def overseas(spark, at):
    """Areas 97001 and 01001, and two that share code 12345; each has three urgent orders of one line item."""
    keys = [97001, 1001, 123450, 123451]
    spark.createDataFrame([(k, 1, 10.0, f"c{k}") for k in keys], "c_custkey long, c_nationkey int, c_acctbal double, c_name string").write.parquet(f"{at}/customer.parquet")
    rows = [(10 * i + j, k) for i, k in enumerate(keys) for j in range(3)]
    spark.createDataFrame([(o, k, "1-URGENT") for o, k in rows], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(o, "1997-05-01", 70_000.0) for o, _ in rows], "l_orderkey long, l_shipdate string, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_areas_overseas_keep_their_facts(spark, tmp_path):
    at = overseas(spark, tmp_path)
    of = lambda name: {r["code"]: r for r in QUERIES[name](spark, at).collect()}
    assert {c: (r["fires"], r["latest"]) for c, r in of("p4_fires").items()} == {"97001": (3, 1997), "01001": (3, 1997), "12345": (6, 1997)}
    assert (of("p5_food_access")["97001"]["large"], of("p5_food_access")["97001"]["food_class"]) == (1, "supermarche")
    assert (of("p6_services")["97001"]["health"], of("p6_services")["97001"]["service_class"]) == (1, "limite")
    assert "97001" in of("p7_income")


def test_incomes_of_areas_that_share_a_code_do_not_cross(spark, tmp_path):
    at = overseas(spark, tmp_path)
    got = sorted(r["median"] - 10_000 for r in QUERIES["p7_income"](spark, at).where("code = '12345'").collect())
    assert got == sorted(1 + k * 7907 % 50_000 for k in (123450, 123451))
