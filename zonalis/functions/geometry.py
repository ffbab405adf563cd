"""Planar geometry as Column expressions over arrays of {x, y} points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(ring: Column) -> Column:
    """Consecutive point pairs {p, q}."""
    ends = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), ends, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def _cross(s: Column) -> Column:
    return s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]


def _moved(ring: Column) -> Column:
    """The ring from its first point on: small numbers keep the cross products exact."""
    first = F.get(ring, F.lit(0))
    return F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(segments(_moved(ring)), _cross)) / 2


def polygon_area(rings: Column) -> Column:
    """First ring less the others (G1)."""
    return _sum(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(signed_area(r))).otherwise(-F.abs(signed_area(r)))))


def line_length(line: Column) -> Column:
    """Sum of segment lengths."""
    return _sum(F.transform(segments(line), lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])))


def bounds(rings: Column) -> dict[str, Column]:
    """West, south, east, north over all points."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def boxes_overlap(b: dict[str, Column], west: float, south: float, east: float, north: float) -> Column:
    """F3."""
    return (b["min_x"] <= east) & (b["max_x"] >= west) & (b["min_y"] <= north) & (b["max_y"] >= south)


def largest_ring_centroid(rings: Column) -> Column:
    """Area centroid of the largest ring, mean of its points where it has no area; four decimals."""
    sized = F.transform(rings, lambda r: F.struct(F.abs(signed_area(r)).alias("a"), r.alias("r")))
    ring = F.get(F.reverse(F.array_sort(sized, lambda l, r: F.when(l["a"] < r["a"], -1).when(l["a"] > r["a"], 1).otherwise(0))), F.lit(0))["r"]
    moved, first = _moved(ring), F.get(ring, F.lit(0))
    area = _sum(F.transform(segments(moved), _cross)) / 2

    def middle(axis: str) -> Column:
        weighted = _sum(F.transform(segments(moved), lambda s: (s["p"][axis] + s["q"][axis]) * _cross(s)))
        mean = _sum(F.transform(moved, lambda p: p[axis])) / F.size(moved)
        return F.round(first[axis] + F.when(F.abs(area) > 1e-12, weighted / (6 * area)).otherwise(mean), 4)

    return F.struct(middle("x").alias("x"), middle("y").alias("y"))


def ray_crossing(x: Column, y: Column, s: Column) -> Column:
    """1 where the ray from (x, y) to the right crosses the segment {p, q}, else 0."""
    p, q = s["p"], s["q"]
    at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
    return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so holes count."""
    counts = F.transform(rings, lambda r: F.aggregate(F.transform(segments(r), lambda s: ray_crossing(x, y, s)), F.lit(0), lambda a, v: a + v))
    return F.aggregate(counts, F.lit(0), lambda a, v: a + v) % 2 == 1


def interior_point(rings: Column) -> Column:
    """Midpoint of the widest inside stretch at half height."""
    b = bounds(rings)
    y = (b["min_y"] + b["max_y"]) / 2 + 1e-9

    def at(s: Column) -> Column:
        p, q = s["p"], s["q"]
        return F.when((p["y"] > y) != (q["y"] > y), p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)))

    cuts = F.array_sort(F.array_compact(F.flatten(F.transform(rings, lambda r: F.transform(segments(r), at)))))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(cuts) / 2).cast("int"), F.lit(1))), lambda i: F.struct((F.get(cuts, 2 * i - 1) - F.get(cuts, 2 * i - 2)).alias("w"), ((F.get(cuts, 2 * i - 1) + F.get(cuts, 2 * i - 2)) / 2).alias("m")))
    return F.struct(F.array_max(pairs)["m"].alias("x"), y.alias("y"))


def square(x0: Column, y0: Column, size: float) -> Column:
    """Closed ring of a grid cell with shared corners."""
    x1, y1 = x0 + size, y0 + size
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def sample_offsets(k: int, size: float) -> list[float]:
    """Centres of k equal parts of a cell side."""
    return [size * (i + 0.5) / k for i in range(k)]


KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON = 111.320


def flat_km(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Equirectangular distance at the first point's latitude."""
    dx = (lon1 - lon0) * KM_PER_DEG_LON * F.cos(F.radians(lat0))
    return F.hypot(dx, (lat1 - lat0) * KM_PER_DEG_LAT)


def shape_faults(rings: Column) -> Column:
    """Names of what is wrong with a polygon in degrees."""
    flat = F.flatten(rings)
    checks = [
        ("empty", F.size(flat) < 1),
        ("short_ring", F.exists(rings, lambda r: F.size(r) < 4)),
        ("open_ring", F.exists(rings, lambda r: F.get(r, F.lit(0)) != F.element_at(r, -1))),
        ("range", F.exists(flat, lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def segments_cross(a: Column, b: Column) -> Column:
    """Proper or touching intersection of two {p, q} segments, collinear overlap left out."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    return (side(a["p"], a["q"], b["p"]) * side(a["p"], a["q"], b["q"]) <= 0) & (side(b["p"], b["q"], a["p"]) * side(b["p"], b["q"], a["q"]) < 0)


def line_meets_polygon(line: Column, rings: Column) -> Column:
    """A vertex inside or a segment across an edge."""
    inside = F.exists(line, lambda p: in_polygon(p["x"], p["y"], rings))
    across = F.exists(segments(line), lambda s: F.exists(rings, lambda r: F.exists(segments(r), lambda e: segments_cross(s, e))))
    return inside | across
