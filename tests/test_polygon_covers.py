"""Polygon covers against the ray test over whole rings."""

import numpy as np
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators import spatial as S


def star(rng, x, y, size, corners):
    at = np.linspace(0, 2 * np.pi, corners, endpoint=False)
    r = size * rng.uniform(0.4, 1.0, corners)
    ring = [(float(x + a * np.cos(t)), float(y + a * np.sin(t))) for a, t in zip(r, at)]
    return [*ring, ring[0]]


def frame(spark, shapes):
    rows = [(n, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for n, rings in shapes.items()]
    return spark.createDataFrame(rows, "poly string, rings array<array<struct<x:double,y:double>>>")


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:]):
            if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
                odd = not odd
    return odd


def shapes(rng):
    """One polygon over thousands of cells with a hole, tiny ones, squares on cell borders, one of many short edges."""
    out = {"country": [star(rng, 3.3, 1.7, 40.0, 400), star(rng, 3.3, 1.7, 9.0, 60)], "coast": [star(rng, -20.0, 20.0, 2.0, 700)]}
    out |= {f"dot{i}": [star(rng, *rng.uniform(-30, 30, 2), 0.02, 9)] for i in range(20)}
    out |= {f"square{i}": [[(i, -1.0), (i + 1.0, -1.0), (i + 1.0, 0.0), (i, 0.0), (i, -1.0)]] for i in range(3)}
    return out | {"flat": [[(5.0, 5.0), (6.0, 5.0), (5.0, 5.0)]], "empty": []}


def test_cover_join_equals_the_ray_test(spark):
    rng = np.random.default_rng(9)
    held = shapes(rng)
    at = [tuple(p) for p in rng.uniform(-45, 45, (1500, 2))] + [tuple(p) for p in rng.normal((-20, 20), 1.5, (500, 2))] + [(i / 2, j / 2) for i in range(-8, 9) for j in range(-8, 9)]
    at += [(x + dx, y) for rings in held.values() for ring in rings for x, y in ring[:40] for dx in (0.0, 1e-7, -1e-7)]
    points = spark.createDataFrame([(i, float(x), float(y), "k") for i, (x, y) in enumerate(at)] + [(-1, None, 0.0, "k")], "id int, x double, y double, k string")
    out = S.points_in_polygons(points, frame(spark, held), 1.0)
    assert out.columns == ["id", "x", "y", "k", "poly"]
    got = sorted((r["id"], r["poly"]) for r in out.collect() if r["poly"])
    assert got == sorted((i, n) for i, (x, y) in enumerate(at) for n, rings in held.items() if inside(x, y, rings))
    assert out.select("id").distinct().count() == len(at) + 1


def test_cells_carry_their_own_edges_only(spark):
    rng = np.random.default_rng(9)
    cover = S.polygon_cover(frame(spark, shapes(rng)), 1.0)
    country = cover.where("poly = 'country'").withColumn("n", F.size("near")).cache()
    assert country.where("n = 0").count() > 1000 and country.agg(F.max("n")).first()[0] <= 16
    # 460 edges in each of the 80 x 80 cells of its box would be three million.
    assert country.agg(F.sum("n")).first()[0] < 0.02 * 460 * 80 * 80
    # Where edges lie closer than the smallest part, a part keeps some more of the 700.
    assert cover.where("poly = 'coast'").agg(F.max(F.size("near"))).first()[0] <= 40


def test_lines_meet_polygons_by_vertex_or_edge(spark):
    rng = np.random.default_rng(3)
    held = {"a": [star(rng, 0.0, 0.0, 3.0, 30)], "b": [[(10.0, 0.0), (11.0, 0.0), (11.0, 1.0), (10.0, 1.0), (10.0, 0.0)]]}
    lines = {"inside": [(0.1, 0.1), (0.2, 0.2)], "across": [(9.0, 0.5), (12.0, 0.6)], "far": [(20.0, 20.0), (21.0, 25.0)], "into": [(-9.0, 0.0), (0.0, 0.0)], "beside": [(9.0, 2.0), (12.0, 2.0)]}
    df = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in line]) for n, line in lines.items()], "line_id string, line array<struct<x:double,y:double>>")
    polygons = frame(spark, held)
    got = {r["line_id"] for r in S.lines_meeting_polygons(df, polygons, 0.5).collect()}
    plain = df.crossJoin(polygons).where(G.line_meets_polygon(F.col("line"), F.col("rings"))).select("line_id").distinct()
    assert got == {r["line_id"] for r in plain.collect()} == {"inside", "across", "into"}
