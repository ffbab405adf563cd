"""Spatial joins as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.runtime import cut, shuffle_partitions


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def polygon_cells(polygons: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """A row for each grid cell that a polygon's box touches."""
    b = G.bounds(F.col(rings))
    xs = F.sequence(_cell(b["min_x"], size), _cell(b["max_x"], size))
    ys = F.sequence(_cell(b["min_y"], size), _cell(b["max_y"], size))
    return polygons.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


#: Edges in a cell of a cover from which on it is split, and how many halvings below the given size.
CROWDED_EDGES, SUB_LEVELS = 16, 6


def _clipped(cells: DataFrame, size: float) -> DataFrame:
    """``cells(poly, k, cx, cy, near, ys, odd)`` with what a point of the cell needs to be told inside or outside.

    A point's ray runs to the right. Edges left of, above or below the cell never count. An edge to the right counts
    whatever the point's x, so it is its two heights in ``ys`` (each height above the point flips); heights that
    neighbouring edges share cancel, those above the whole cell flip ``odd``. Only edges that meet the cell stay whole
    in ``near``. The cell's box is a little wider than the cell, so rounding moves no edge out of it.
    """
    side = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("k"))
    low = {c: F.col(c) * side for c in ("cx", "cy")}
    more = {c: (F.abs(low[c]) + side) * 1e-9 for c in low}
    cells = cells.withColumns({"__w": low["cx"] - more["cx"], "__e": low["cx"] + side + more["cx"], "__s": low["cy"] - more["cy"], "__t": low["cy"] + side + more["cy"]})
    w, e, s, t = (F.col(c) for c in ("__w", "__e", "__s", "__t"))
    in_band = lambda g: ~((F.greatest(g["p"]["y"], g["q"]["y"]) <= s) | (F.least(g["p"]["y"], g["q"]["y"]) >= t))
    right = F.filter("near", lambda g: in_band(g) & (F.least(g["p"]["x"], g["q"]["x"]) > e))
    cells = cells.withColumn("__right", right)
    before, after = lambda i: F.get("__right", i - 1)["q"], lambda i: F.get("__right", i + 1)["p"]
    starts = F.transform("__right", lambda g, i: F.when(before(i).isNull() | (before(i) != g["p"]), g["p"]["y"]))
    ends = F.transform("__right", lambda g, i: F.when(after(i).isNull() | (after(i) != g["q"]), g["q"]["y"]))
    cells = cells.withColumn("__ys", F.array_compact(F.concat("ys", starts, ends)))
    near = F.filter("near", lambda g: in_band(g) & (F.greatest(g["p"]["x"], g["q"]["x"]) >= w) & (F.least(g["p"]["x"], g["q"]["x"]) <= e) & (g["p"]["y"] != g["q"]["y"]))
    flips = F.size(F.filter("__ys", lambda y: y >= t))
    return cells.select("poly", "k", "cx", "cy", near.alias("near"), F.filter("__ys", lambda y: (y > s) & (y < t)).alias("ys"), ((F.col("odd") + flips) % 2).alias("odd"))


def polygon_cover(polygons: DataFrame, size: float, most: int = CROWDED_EDGES) -> DataFrame:
    """``(poly, cx, cy, k, sx, sy, near, ys, odd)``: cells of side ``size`` and, where they are crowded with edges, parts
    of them, each with its own edges alone; ``near`` and ``ys`` are empty in a cell that is wholly inside.

    ``polygons(poly, rings)``. A polygon starts with the few cells of about its own width and is cut into quarters; each
    quarter keeps the edges that meet it, so a large polygon's outline never goes to all its cells, and cells inside
    it carry no edge. A cell of more than ``most`` edges is cut on, SUB_LEVELS times at most.
    """
    b = G.bounds(F.col("rings"))
    cells = polygons.select("poly", F.flatten(F.transform("rings", G.segments)).alias("near"), *[v.alias(c) for c, v in b.items()])
    width = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / F.lit(float(size))
    cells = cells.where(width >= 0).withColumn("k", F.when(width > 1, F.ceil(F.log2(width))).otherwise(F.lit(0)).cast("int"))
    side = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("k"))
    of = lambda axis: F.explode(F.sequence(F.floor(F.col(f"min_{axis}") / side), F.floor(F.col(f"max_{axis}") / side)))
    cells = cells.withColumn("cx", of("x")).withColumn("cy", of("y"))
    cells = _clipped(cells.select("poly", "k", "cx", "cy", "near", F.array().cast("array<double>").alias("ys"), F.lit(0).alias("odd")), size)
    found = None
    quarters = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)]))
    while True:
        plain = (F.size("near") == 0) & (F.size("ys") == 0)
        cells = cut(cells.where(~plain | (F.col("odd") == 1)))
        done = plain | ((F.col("k") <= 0) & (F.size("near") + F.size("ys") <= most)) | (F.col("k") <= -SUB_LEVELS)
        found = cells.where(done) if found is None else found.unionByName(cells.where(done))
        if cells.where(~done).isEmpty():
            break
        parts = cells.where(~done).withColumn("q", quarters)
        cells = _clipped(parts.select("poly", (F.col("k") - 1).alias("k"), "q.cx", "q.cy", "near", "ys", "odd"), size)
    # A whole cell above the given size stands for its cells of that size, a part for the cell it lies in.
    times = F.pow(F.lit(2.0), F.abs("k")).cast("bigint")
    base = lambda c: F.when(F.col("k") > 0, F.sequence(F.col(c) * times, F.col(c) * times + times - 1)).otherwise(F.array(F.floor(F.col(c) / times)))
    out = found.select("poly", "k", F.col("cx").alias("sx"), F.col("cy").alias("sy"), base("cx").alias("xs"), base("cy").alias("ys0"), "near", "ys", "odd")
    return out.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys0")).select("poly", "cx", "cy", "k", "sx", "sy", "near", "ys", "odd")


def _in_cover(x: Column, y: Column, size: float) -> Column:
    """Whether a point of a cover's cell is inside its polygon."""
    part = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("k"))
    here = (F.col("k") >= 0) | ((F.floor(x / part) == F.col("sx")) & (F.floor(y / part) == F.col("sy")))
    flips = F.aggregate("near", F.lit(0), lambda n, g: n + G.ray_crossing(x, y, g)) + F.size(F.filter("ys", lambda v: v > y)) + F.col("odd")
    return here & (flips % 2 == 1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Left join of ``points`` with the polygons that hold them (J9). ``polygons(poly, rings)``.

    Points and the cells of polygon_cover() meet on the cell; there the ray test runs over the cell's edges alone, with
    the result of the whole rings. Polygons may be of any size; ``size`` is best about a usual polygon's side.
    """
    placed = points.withColumns({"__px": _cell(F.col(x), size), "__py": _cell(F.col(y), size)})
    cells = polygon_cover(polygons.select("poly", "rings"), size)
    same = (F.col("__px") == F.col("cx")) & (F.col("__py") == F.col("cy"))
    names = [c for c in points.columns if c in cells.columns and c != "poly"]
    placed = placed.withColumnsRenamed({c: f"__own_{c}" for c in names})
    px, py = (F.col(f"__own_{c}" if c in names else c) for c in (x, y))
    joined = placed.join(cells, same & _in_cover(px, py, size), "left")
    return joined.select(*[F.col(f"__own_{c}").alias(c) if c in names else F.col(c) for c in points.columns], "poly")


def one_polygon(matched: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest polygon code where a boundary point has several.

    ``keys`` name a point; points that are equal in all of them stay as many rows as they were.
    """
    times = matched.groupBy(*keys, "poly").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.min("poly").alias("poly"), F.max("__n").alias("__n"))
    return times.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def lines_meeting_polygons(lines: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Lines that meet any polygon (J10). ``lines(line_id, line)``, ``polygons(poly, rings)``.

    A line meets a polygon if a vertex lies inside or a piece crosses an edge. Vertices meet polygon covers; pieces meet
    edges on the cells of their boxes. No whole line or ring is copied.
    """
    corner = lines.select("line_id", F.explode("line").alias("p")).select("line_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    inside = points_in_polygons(corner, polygons, size).where("poly is not null").select("line_id")
    boxed = lambda df: polygon_cells(df.withColumn("rings", F.array(F.array("g.p", "g.q"))), size).drop("rings")
    pieces = boxed(lines.select("line_id", F.explode(G.segments(F.col("line"))).alias("g")))
    edges = boxed(polygons.select(F.explode(F.flatten(F.transform("rings", G.segments))).alias("g"))).withColumnRenamed("g", "h")
    across = pieces.join(edges, ["cx", "cy"]).where(G.segments_cross(F.col("g"), F.col("h"))).select("line_id")
    return lines.join(inside.unionByName(across).distinct(), "line_id", "left_semi")


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(scale_x: float = 1.0) -> Column:
    """Between ``x, y`` and ``rx, ry``."""
    return _length((F.col("rx") - F.col("x")) * scale_x, F.col("ry") - F.col("y"))


def _neighbourhood(df: DataFrame, x: Column, y: Column, reach: int = 1) -> DataFrame:
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    return df.withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps)).withColumns({"cx": x + F.col("__dx"), "cy": y + F.col("__dy")}).drop("__dx", "__dy")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, scale_x: float = 1.0, tasks: int | None = None) -> DataFrame:
    """Pairs of ``left(id, x, y, ...)`` and ``right(rid, rx, ry, ...)`` at most ``radius`` apart.

    Cells are half a radius wide; the right side goes to its 25 neighbours. ``tasks`` deals the cells to so many, where
    few bytes have many pairs: adaptive execution would join their partitions, or a broadcast leave them to few tasks.
    """
    cell = radius / 2
    a = left.withColumns({"cx": _cell(F.col("x"), cell), "cy": _cell(F.col("y"), cell)})
    if tasks:
        a = a.repartition(tasks, "cx", "cy").hint("merge")
    b = _neighbourhood(right, _cell(F.col("rx"), cell), _cell(F.col("ry"), cell), 2)
    near = a.join(b, ["cx", "cy"]).withColumn("distance", distance(scale_x))
    return near.where(F.col("distance") <= radius).drop("cx", "cy")


def sums_within(points: DataFrame, sites: DataFrame, radius: float, sums: Mapping[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """``(x, y, ...)``: for each place of ``points(x, y)``, sums over the ``sites(rx, ry, weights...)`` at most ``radius``
    away; a place without any has no row.

    ``sums``: name -> weight column and its factor by distance. Rows of one place are one row on either side, with
    their weights added, so pairs grow with the places and not with the rows that share them.
    """
    weights = list(dict.fromkeys(w for w, _ in sums.values()))
    at = sites.groupBy("rx", "ry").agg(*[F.sum(w).alias(w) for w in weights])
    near = pairs_within(points.select("x", "y").distinct(), at, radius, tasks=shuffle_partitions(points.sparkSession))
    return near.groupBy("x", "y").agg(*[F.sum(F.col(w) * f(F.col("distance"))).alias(name) for name, (w, f) in sums.items()])


#: Doublings of the cells before the rows that are left look up where they have a neighbour at all.
DOUBLINGS = 3


def nearest(points: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """``(id, site, distance)``: the nearest of ``sites(site, sx, sy)`` for each ``points(id, x, y)``.

    Places are searched, not rows: points at one place share its result, sites at one place are the smallest of them.
    A place whose best site in the 3 x 3 cells is within one cell width is settled; the others try again with
    cells twice as wide, so a dense area never compares with far sites. The first cells are as wide as leaves about one
    site to a cell, ``size`` at most, so the pairs of a place don't grow with the sites. After DOUBLINGS rounds the few
    that are left go straight to the level of a pyramid of occupied cells that surely holds their nearest site, so the
    number of rounds doesn't grow with the gap. Ties go to the smaller site. Every point returns a row of its own,
    repeated ids too; ``site`` is NULL for a point without finite coordinates and where there are no sites.
    """
    return with_nearest(points.select("id", "x", "y"), sites, size).select("id", "site", "distance")


def with_nearest(points: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """``points(x, y, ...)`` with ``site`` and ``distance`` of nearest()."""
    found = None
    finite = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))
    rest = cut(points.select("x", "y").where(finite("x") & finite("y")).distinct())
    sites = sites.where(finite("sx") & finite("sy")).groupBy("sx", "sy").agg(F.min("site").alias("site"))
    if sites.isEmpty() or rest.isEmpty():
        return points.withColumns({"site": F.lit(None).cast(sites.schema["site"].dataType), "distance": F.lit(None).cast("double")})
    size = min(float(size), _usual_gap(sites) or float(size))
    d = _length(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    best_of = lambda met: met.groupBy("x", "y").agg(F.min(F.struct(d.alias("distance"), "site")).alias("best")).select("x", "y", "best.site", "best.distance")
    back = lambda found: points.join(found, ["x", "y"], "left").select(*points.columns, "site", "distance")
    for _ in range(DOUBLINGS):
        a = rest.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
        b = _neighbourhood(sites, _cell(F.col("sx"), size), _cell(F.col("sy"), size))
        best = cut(best_of(a.join(b, ["cx", "cy"])).where(F.col("distance") <= size))
        found = best if found is None else found.unionByName(best)
        rest = cut(rest.join(best, ["x", "y"], "left_anti"))
        size *= 2
        if rest.isEmpty():
            return back(found)
    return back(found.unionByName(cut(best_of(_at_own_level(rest, sites, size)))))


def _usual_gap(sites: DataFrame) -> float | None:
    """The width of a cell that would hold one of ``sites(sx, sy)`` if they lay evenly in their box; None at one place."""
    s = sites.agg(F.count("*").alias("n"), (F.max("sx") - F.min("sx")).alias("w"), (F.max("sy") - F.min("sy")).alias("h")).first()
    return max(math.sqrt(s["w"] * s["h"] / s["n"]), max(s["w"], s["h"]) / s["n"]) or None


def _at_own_level(rest: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """``rest(x, y)`` with all ``sites`` that can be nearest, on cells of each place's own width.

    The first level whose 3 x 3 cells hold any site bounds the distance by 2.83 cell widths; cells four times as wide
    then have the nearest site among theirs.
    """
    span = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    p, q = span(rest, "x", "y"), span(sites, "sx", "sy")
    extent = max(max(p[1], q[1]) - min(p[0], q[0]), max(p[3], q[3]) - min(p[2], q[2]), size)
    top = math.ceil(math.log2(extent / size)) + 1
    width = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))
    placed = lambda df, x, y: df.withColumns({"cx": F.floor(F.col(x) / width), "cy": F.floor(F.col(y) / width)})
    occupied = placed(sites.select("sx", "sy", levels.alias("level")), "sx", "sy").select("level", "cx", "cy").distinct()
    round_ = lambda df: _neighbourhood(df, F.floor(F.col("x") / width), F.floor(F.col("y") / width))
    first = round_(rest.withColumn("level", levels)).join(occupied, ["level", "cx", "cy"]).groupBy("x", "y").agg(F.least(F.min("level") + 2, F.lit(top)).alias("level"))
    own = cut(rest.join(first, ["x", "y"]))
    used = [r["level"] for r in own.select("level").distinct().collect()]  # one row a level
    spread = placed(sites.withColumn("level", F.explode(F.array(*map(F.lit, used)))), "sx", "sy")
    return round_(own).join(spread, ["level", "cx", "cy"])


def mosaic_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """``(a, b, n)``: every edge of a mosaic in one direction and how many polygons have it; those with 1 are the
    outline (G12). Corners must be shared exactly."""
    s = polygons.select(F.explode(F.flatten(F.transform(rings, G.segments))).alias("s"))
    end = lambda p: F.struct((F.col(f"s.{p}.x") + 0.0).alias("x"), (F.col(f"s.{p}.y") + 0.0).alias("y"))
    return s.groupBy(F.least(end("p"), end("q")).alias("a"), F.greatest(end("p"), end("q")).alias("b")).agg(F.count("*").alias("n"))


def city_labels(areas: DataFrame, least: int = 10_000, rings: str = "rings") -> DataFrame:
    """``(name, population, x, y)``: a point inside every large area, largest first."""
    large = areas.where(F.col("population") >= least).withColumn("__p", G.interior_point(F.col(rings)))
    return large.select("name", "population", F.col("__p.x").alias("x"), F.col("__p.y").alias("y")).orderBy(F.col("population").desc(), "name")
