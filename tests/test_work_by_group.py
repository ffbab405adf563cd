"""Work is done once a group, place or code, not once a row or pair of rows."""

import re

from tests.test_queries import QUERIES
from zonalis.plans.catalogue import Views
from zonalis.plans.q_pipelines_more import areas_of


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_m36_people_and_points_meet_as_sums_of_a_cell(spark, sf):
    grouped = [line for line in plan(QUERIES["m36_area_climate_table"](spark, sf)).splitlines() if re.search(r"Aggregate \[.*gx#", line)]
    assert len({line.lstrip(" :+-") for line in grouped}) >= 2


def test_p22_areas_are_not_filtered_row_by_row(spark, sf):
    assert not [f for f in areas_of(Views(spark, sf)).inputFiles() if f.endswith("customer.parquet")]


def test_p9_codes_are_not_checked_line_item_by_line_item(spark, sf):
    assert not [f for f in QUERIES["p9_age_structure"](spark, sf).inputFiles() if f.endswith("lineitem.parquet")]


def test_a29_trips_are_told_apart_where_they_lie(spark, sf):
    assert "Expand" not in plan(QUERIES["a29_stop_service"](spark, sf))


def test_r9_calls_stay_with_their_trip(spark, sf):
    for name in ("r7_r9_hop_and_spur_loads", "r9_piece_loads"):
        assert not re.search(r"hashpartitioning\(trip#\d+L?, pos#", plan(QUERIES[name](spark, sf), "executedPlan"))
