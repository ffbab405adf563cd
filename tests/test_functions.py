"""Literal cases of scalar and geometry functions."""

import pytest
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions import keys as K
from zonalis.functions import projections as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("1001", "01001"), (" 2a004 ", "2A004"), ("1001.0", "01001"), ("", None), ("nan", None), ("None", None), ("2C004", None), ("123456", None), (None, None), ("0", "00000")])
def test_codes(spark, raw, want):
    assert one(spark, K.normalise_code(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("55,08%", 55.08), ("1 234,5", 1234.5), ("-", None), ("", None), ("1\xa0000", 1000.0), (None, None)])
def test_numbers(spark, raw, want):
    assert one(spark, K.number(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("87-391003", "87391003"), ("391003.0", "00391003"), ("1234567890", "34567890"), ("x", None)])
def test_uic(spark, raw, want):
    assert one(spark, K.uic8(F.lit(raw))) == want


def test_small_scalars(spark):
    assert one(spark, K.best_grade(F.lit("c; B;"))) == "B" and one(spark, K.best_grade(F.lit("z"))) is None
    assert [one(spark, K.age_index(F.lit(a))) for a in ("Y7", "Y_GE100", "Y105", "_T")] == [7, 100, 100, None]
    assert one(spark, K.clock_minutes(F.lit("25:10:00"))) == 1510
    assert one(spark, K.department(F.lit("97105"))) == "971" and one(spark, K.department(F.lit("2A004"))) == "2A"
    assert one(spark, K.is_metropolitan(F.lit("97105"))) is False and one(spark, K.is_metropolitan(F.lit(None).cast("string"))) is False
    assert one(spark, K.founding_year(F.lit("01/01/2005"))) == 2005 and one(spark, K.founding_year(F.lit("vers 1700"))) is None
    assert [one(spark, K.span_days(F.lit(t))) for t in ("2 days 12:00:00", "3.5", "nan?", "06:00:00")] == [2.5, 3.5, None, 0.25]
    assert one(spark, K.folded_name(F.lit("Œuvre-Été"))) == "oeuvre ete"
    assert one(spark, K.duration_label(F.lit(65))) == "1h05" and one(spark, K.frequency_label(F.lit(3))) == "3/week"
    assert one(spark, K.strength_words(F.lit(-0.55))) == "a strong negative relationship nationally"
    assert one(spark, K.tile_key(F.lit(-0.5), F.lit(44.2))) == "N44_W001"
    assert one(spark, K.parent_code(F.lit("75103"))) == "75056"
    assert one(spark, K.museum_weight(F.lit(None).cast("double"))) == 1.0 and one(spark, K.museum_weight(F.lit(1e12))) == 6.0


def test_typical_week(spark):
    week = one(spark, K.typical_week(F.to_date(F.lit("2024-01-03"))))
    assert [str(week[0]), str(week[-1]), len(week)] == ["2024-01-15", "2024-01-21", 7]
    pinned = F.to_date(F.lit("2024-02-05"))
    assert str(one(spark, K.typical_week(F.to_date(F.lit("2024-01-03")), pinned))[0]) == "2024-02-05"
    assert one(spark, K.typical_week(F.to_date(F.lit("2024-01-03")), F.to_date(F.lit("2024-02-06")))) is None


def test_delta_coding(spark):
    xs = F.array(*map(F.lit, [2.35, 2.35001, 2.3]))
    assert one(spark, K.delta_encoded(xs)) == [235000, 1, -5001]
    assert [round(v, 5) for v in one(spark, K.delta_decoded(K.delta_encoded(xs)))] == [2.35, 2.35001, 2.3]


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))


def test_polygon_with_a_hole(spark):
    rings = F.array(ring(*SQUARE), ring(*HOLE))
    assert one(spark, G.polygon_area(rings)) == 12.0
    inside = [one(spark, G.in_polygon(F.lit(x), F.lit(y), rings)) for x, y in ((0.5, 0.5), (2.0, 2.0), (5.0, 1.0))]
    assert inside == [True, False, False]
    p = one(spark, G.interior_point(rings))
    assert one(spark, G.in_polygon(F.lit(p["x"]), F.lit(p["y"]), rings))
    assert tuple(one(spark, G.largest_ring_centroid(rings))) == (2.0, 2.0)


def test_line_and_polygon(spark):
    rings = F.array(ring(*SQUARE))
    assert one(spark, G.line_length(ring((0, 0), (3, 4), (3, 5)))) == 6.0
    meets = [one(spark, G.line_meets_polygon(ring(*line), rings)) for line in (((-1, 2), (5, 2)), ((1, 1), (2, 2)), ((5, 5), (6, 6)))]
    assert meets == [True, True, False]
    assert one(spark, G.shape_faults(F.array(ring((0, 0), (200, 0), (0, 1))))) == ["short_ring", "open_ring", "range"]


def test_known_projected_points(spark):
    x, y = P.lambert93(F.lit(3.0), F.lit(46.5))
    assert abs(one(spark, x) - 700_000) < 1e-3 and abs(one(spark, y) - 6_600_000) < 1e-3
    x, y = P.laea(F.lit(10.0), F.lit(52.0))
    assert abs(one(spark, x) - 4_321_000) < 1e-3 and abs(one(spark, y) - 3_210_000) < 1e-3
    lon, lat = P.from_lambert2e(F.lit(600_000.0), F.lit(2_200_000.0))
    assert abs(one(spark, lon) - 2.3372) < 2e-3 and abs(one(spark, lat) - 46.8) < 2e-3
