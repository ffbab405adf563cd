"""Track graphs and stop patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.operators.graph_components import connected_components
from zonalis.operators.routing import quickest
from zonalis.runtime import cut


def merged_nodes(unions: DataFrame) -> DataFrame:
    """``(node, component)`` of ``unions(a, b)``: ends that are one junction."""
    return connected_components(unions, "a", "b")


def nearby_lines(points: DataFrame, lines: DataFrame, limit: float) -> DataFrame:
    """``(pid, lid, away, along, px, py)``: every line within ``limit`` of each point, and its place nearest to it.

    ``points(pid, x, y)``, with ``own`` naming a line to skip; ``lines(lid, x0, y0, x1, y1)``: straight pieces, with
    ``s0`` the piece's start along its line. Each piece goes to the cells of its box widened by the limit; a point
    looks in its own cell.
    """
    size = limit * 4
    if "s0" not in lines.columns:
        lines = lines.withColumn("s0", F.lit(0.0))
    low = lambda a, b: F.floor((F.least(a, b) - limit) / size)
    high = lambda a, b: F.floor((F.greatest(a, b) + limit) / size)
    boxed = lines.withColumn("cx", F.explode(F.sequence(low("x0", "x1"), high("x0", "x1")))).withColumn("cy", F.explode(F.sequence(low("y0", "y1"), high("y0", "y1"))))
    placed = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    near = placed.join(boxed, ["cx", "cy"]).withColumn("t", t)
    if "own" in points.columns:
        near = near.where(~F.col("lid").eqNullSafe(F.col("own")))
    near = near.withColumns({"px": F.col("x0") + F.col("t") * dx, "py": F.col("y0") + F.col("t") * dy, "along": F.col("s0") + F.col("t") * F.sqrt(square)})
    near = near.withColumn("away", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("away") <= limit)
    return near.groupBy("pid", "lid").agg(F.min(F.struct("away", "along", "px", "py")).alias("m")).select("pid", "lid", "m.*")


def snapped_points(points: DataFrame, lines: DataFrame, limit: float) -> DataFrame:
    """The nearest of nearby_lines() of each point, ties (to twelve digits) to the smaller line (R2)."""
    near = nearby_lines(points, lines, limit).withColumn("tie", F.round("away", 12))
    return near.groupBy("pid").agg(F.min(F.struct("tie", "lid", "away", "along", "px", "py")).alias("m")).select("pid", "m.lid", "m.away", "m.along", "m.px", "m.py")


def station_lines(stops: DataFrame, lines: DataFrame, limit: float, extra: float) -> DataFrame:
    """``(pid, lid, away, along, px, py, home)``: a stop's nearest line (``home``) and every classic line at most
    ``extra`` farther away than that (R2). ``lines`` carry ``lgv``; a passing high-speed line is only joined as home.
    """
    near = nearby_lines(stops, lines, limit)
    home = near.groupBy("pid").agg(F.min(F.struct("away", "lid")).alias("h"))
    kind = lines.groupBy("lid").agg(F.bool_or("lgv").alias("lgv"))
    both = near.join(home, "pid").join(kind, "lid").withColumn("home", F.col("lid") == F.col("h.lid"))
    kept = both.where(F.col("home") | ((F.col("away") <= F.col("h.away") + extra) & ~F.coalesce("lgv", F.lit(False))))
    return kept.select("pid", "lid", "away", "along", "px", "py", "home")


def close_cuts(cuts: DataFrame, merge: float = 0.5) -> DataFrame:
    """``(a, b)``: nodes of neighbouring cuts of a line closer than ``merge``, which are one."""
    return _pieces(cuts).where(F.col("length") < merge).select(F.col("node").alias("a"), F.col("dst").alias("b"))


def _pieces(cuts: DataFrame) -> DataFrame:
    w = W.partitionBy("lid").orderBy("s", "node")
    rows = cuts.withColumns({"to_s": F.lead("s").over(w), "dst": F.lead("node").over(w)}).where("to_s is not null")
    return rows.withColumn("length", F.col("to_s") - F.col("s"))


def united(nodes: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``nodes`` with ``column`` replaced by its junction in ``merged(node, component)``, where it has one."""
    names = merged.select(F.col("node").alias("__n"), "component")
    return nodes.join(names, F.col(column) == F.col("__n"), "left").withColumn(column, F.coalesce("component", column)).drop("__n", "component")


def cut_edges(cuts: DataFrame, speeds: DataFrame, default: float = 80.0, merge: float = 0.5, merged: DataFrame | None = None) -> DataFrame:
    """Edges between consecutive cut positions of each line with travel seconds.

    ``cuts(lid, s, node)``, ``speeds(lid, kmh, lgv)``. Nodes of cuts closer than ``merge`` to the one before are united
    and have no edge between them, so every node stays on the network under its junction's name; ``merged`` may give
    the junctions, close_cuts() among them.
    """
    if merged is None:
        merged = merged_nodes(close_cuts(cuts, merge))
    joined = _pieces(cuts).where(F.col("length") >= merge).join(speeds, "lid", "left")
    seconds = F.col("length") / (F.coalesce("kmh", F.lit(default)) / 3.6)
    rows = joined.select("lid", "s", F.col("node").alias("src"), "dst", "length", seconds.alias("seconds"), F.coalesce("lgv", F.lit(False)).alias("lgv"))
    return united(united(rows, "src", merged), "dst", merged)


def grid_node(x: Column, y: Column) -> Column:
    """Name of the metre square that a node lies in."""
    return F.concat_ws(":", F.rint(x).cast("bigint").cast("string"), F.rint(y).cast("bigint").cast("string"))


def track_graph(lines: DataFrame, stops: DataFrame, speeds: DataFrame, junction: float, station: float, extra: float, default: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """``(edges, at)``: the network cut at every junction and stop, and ``(stop, node)`` of the stops on it.

    ``lines(lid, x0, y0, x1, y1, s0, lgv)`` in metres, ``stops(pid, x, y)``, ``speeds(lid, kmh, lgv)``. A line's ends
    join the nearest other line within ``junction``; a stop joins those of station_lines().
    """
    first = F.min_by(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("s0").alias("s")), "s0")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    last = F.max_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("s0") + length).alias("s")), "s0")
    ends = lines.groupBy("lid").agg(F.array(first, last).alias("e")).select("lid", F.posexplode("e").alias("side", "p"))
    ends = cut(ends.select(F.struct("lid", "side").alias("pid"), F.col("lid").alias("own"), "p.x", "p.y", "p.s"))
    loose = cut(snapped_points(ends.select("pid", "x", "y", "own"), lines, junction).select("pid", "lid", F.col("along").alias("s"), grid_node(F.col("px"), F.col("py")).alias("node")))
    near = station_lines(stops, lines, station, extra)
    near = cut(near.select("pid", "lid", F.col("along").alias("s"), grid_node(F.col("px"), F.col("py")).alias("node"), "home"))
    here = ends.select("pid", "own", "s", grid_node(F.col("x"), F.col("y")).alias("end"))
    cuts = here.select(F.col("own").alias("lid"), "s", F.col("end").alias("node")).unionByName(loose.select("lid", "s", "node")).unionByName(near.select("lid", "s", "node"))
    cuts = cut(cuts.dropDuplicates(["lid", "s", "node"]))
    home = near.where("home").select("pid", F.col("node").alias("home_node"))
    unions = loose.join(here, "pid").select(F.col("end").alias("a"), F.col("node").alias("b"))
    unions = unions.unionByName(near.where("not home").join(home, "pid").select(F.col("node").alias("a"), F.col("home_node").alias("b")))
    merged = cut(merged_nodes(unions.unionByName(close_cuts(cuts))))
    edges = cut_edges(cuts, speeds, default, merged=merged).withColumn("piece", F.pmod(F.xxhash64("lid", "s"), F.lit(1 << 62)))
    at = united(home.select(F.col("pid").alias("stop"), F.col("home_node").alias("node")), "node", merged)
    return cut(edges), at


def judged_hops(hops: DataFrame, routes: DataFrame, detour: float = 2.5, slack: float = 20_000.0, keys: tuple[str, ...] = ("source", "node")) -> DataFrame:
    """Hops with their route, or the reason to draw them straight.

    ``hops(source, node, crow)``, ``routes`` from quickest().
    """
    joined = hops.join(routes, list(keys), "left")
    far = F.col("metres") > F.greatest(detour * F.col("crow"), F.col("crow") + slack)
    reason = F.when(F.col("cost").isNull(), "no connected track").when(F.size("path") == 0, "both stops on one point").when(far, "route far longer than the crow flies")
    return joined.withColumn("straight", reason)


def routed_hops(edges: DataFrame, calls: DataFrame, stops: DataFrame, fast: str, car: str, penalty: float = 4.0) -> DataFrame:
    """Hops between consecutive stops of all trips but ``car``, along the track.

    ``calls(trip, product, pos, stop)``, ``stops(stop, node, x, y)``. Trips of product ``fast`` take high-speed track
    as it is, the others pay the penalty. ``numbers`` are the pieces of the way as renumbered by used_pieces().
    """
    w = W.partitionBy("trip").orderBy("pos")
    group = F.when(F.col("product") == fast, "fast").otherwise("rail")
    pairs = calls.where(F.col("product") != car).select(group.alias("grp"), "stop", F.lead("stop").over(w).alias("to")).where("to <> stop")
    pairs = pairs.select("grp", F.least("stop", "to").alias("a"), F.greatest("stop", "to").alias("b")).distinct()
    here = stops.select(F.col("stop").alias("a"), F.col("node").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    there = stops.select(F.col("stop").alias("b"), "node", F.col("x").alias("bx"), F.col("y").alias("by"))
    hops = pairs.join(here, "a", "left").join(there, "b", "left").withColumn("crow", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    hops = cut(hops.select("grp", "a", "b", "source", "node", "crow"))
    hops = hops.withColumn("penalty", F.when(F.col("grp") == "fast", F.lit(1.0)).otherwise(F.lit(float(penalty))))
    wanted = hops.where("source is not null and node is not null").select("source", "penalty", "node").distinct()
    ways = quickest(edges, wanted.select("source", "penalty").distinct(), wanted=wanted)
    judged = judged_hops(hops, ways, keys=("source", "penalty", "node")).drop("penalty")
    off = F.when(F.col("source").isNull() | F.col("node").isNull(), F.lit("stop off the network"))
    judged = cut(judged.withColumn("straight", F.coalesce(off, "straight")))
    steps = judged.where("straight is null").select("grp", "a", "b", F.posexplode("path").alias("at", "piece")).join(used_pieces(judged), "piece")
    steps = steps.groupBy("grp", "a", "b").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("steps"))
    out = judged.join(steps, ["grp", "a", "b"], "left")
    along = lambda c: F.when(F.col("straight").isNull(), F.col(c))
    return out.select("grp", "a", "b", F.coalesce("straight", F.lit("routed")).alias("outcome"), F.round(along("cost"), 6).alias("cost"), along("metres").alias("metres"), F.col("steps.number").alias("numbers"))


def used_pieces(hops: DataFrame) -> DataFrame:
    """``(piece, number)``: pieces that routed hops use, numbered from 0."""
    from zonalis.operators.ranking import distributed_row_number

    pieces = hops.where("straight is null").select(F.explode("path").alias("piece")).distinct()
    return distributed_row_number(pieces, [F.col("piece")], "number").withColumn("number", F.col("number") - 1)


def rides(calls: DataFrame, origin: Column | int, car: str | None = None) -> DataFrame:
    """Later calls of every trip that boards at ``origin`` (R7): trip, product, terminus, stop, the stop before, minutes since.

    ``calls(trip, product, pos, stop, minutes)``, optional ``no_pickup`` and ``no_drop``. The first call always
    boards, the last always sets down and doesn't board.
    """
    for flag in ("no_pickup", "no_drop"):
        if flag not in calls.columns:
            calls = calls.withColumn(flag, F.lit(False))
    w = W.partitionBy("trip")
    full = calls.withColumns({"last": F.max("pos").over(w), "terminus": F.max_by("stop", "pos").over(w), "prev": F.lag("stop").over(w.orderBy("pos"))})
    boards = full.where((F.col("stop") == origin) & (F.col("pos") < F.col("last")) & (~F.col("no_pickup") | (F.col("pos") == 1)))
    if car is not None:
        boards = boards.where(F.col("product") != car)
    boards = boards.select("trip", "product", "terminus", F.col("pos").alias("from_pos"), F.col("minutes").alias("start"))
    after = full.select("trip", "pos", "stop", "prev", "minutes", (F.col("no_drop") & (F.col("pos") < F.col("last"))).alias("no_drop"))
    joined = boards.join(after, "trip").where("pos > from_pos")
    return joined.select("trip", "product", "terminus", "from_pos", "pos", "stop", "prev", (F.col("minutes") - F.col("start")).alias("since"), "no_drop")


def destinations(later: DataFrame, origin: Column | int) -> DataFrame:
    """Runs, fastest time and products per stop reached without changing."""
    reached = later.where(~F.col("no_drop") & (F.col("stop") != origin))
    return reached.groupBy("stop").agg(F.count("*").alias("runs"), F.min("since").alias("fastest"), F.array_sort(F.collect_set("product")).alias("products"))


def hop_runs(later: DataFrame) -> DataFrame:
    """Runs per product and pair of consecutive stops ridden (R7), of rides()."""
    return later.groupBy("product", F.least("prev", "stop").alias("a"), F.greatest("prev", "stop").alias("b")).agg(F.count("*").alias("runs"))


def call_orders(later: DataFrame, origin: Column | int) -> DataFrame:
    """``(terminus, runs, fastest, place, stop, stop_runs, stop_fastest, every_run)``.

    All trips' calls to a terminus in one order: a stop comes when all stops that precede it in some trip have
    come, the one reached soonest first. A terminus has as many rows as it has stops and successions of stops,
    whatever the trips, and these few go to one task.
    """
    line = later.where(F.col("terminus") != origin)
    kept = line.where(~F.col("no_drop") & (F.col("stop") != origin))
    w = W.partitionBy("trip", "from_pos").orderBy("pos")
    stops = kept.groupBy("terminus", "stop").agg(F.count("*").alias("runs"), F.min("since").alias("fastest"))
    # The stop before among those kept, not among all calls.
    pairs = kept.withColumn("prev", F.lag("stop").over(w)).where("prev is not null").select("terminus", "prev", "stop").distinct()
    # A trip's rides lie together, so they are told apart where they are.
    totals = line.select("terminus", "trip", "from_pos").distinct().groupBy("terminus").agg(F.count("*").alias("line_runs"))

    def order(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        follow: dict = {}
        waiting = dict.fromkeys(left["stop"], 0)
        for a, b in zip(right["prev"], right["stop"]):
            follow.setdefault(a, []).append(b)
            waiting[b] += 1
        soon = dict(zip(left["stop"], left["fastest"]))
        out = []
        while waiting:
            pick = min(waiting, key=lambda s: (waiting[s] > 0, soon[s], s))
            del waiting[pick]
            out.append(pick)
            for b in follow.get(pick, ()):
                if b in waiting:
                    waiting[b] -= 1
        place = {s: i for i, s in enumerate(out)}
        return left.assign(place=left["stop"].map(place))[["terminus", "stop", "runs", "fastest", "place"]]

    schema = f"terminus {later.schema['terminus'].dataType.simpleString()}, stop {later.schema['stop'].dataType.simpleString()}, runs bigint, fastest bigint, place bigint"
    # Cut, so that the two sides of the cogroup don't share a lineage.
    stops = cut(stops.withColumn("fastest", F.col("fastest").cast("bigint")))
    placed = stops.groupBy("terminus").cogroup(pairs.groupBy("terminus")).applyInPandas(order, schema)
    return placed.join(totals, "terminus").withColumn("every_run", F.col("runs") == F.col("line_runs"))


def piece_loads(hops: DataFrame, paths: DataFrame) -> DataFrame:
    """Runs over each piece of track by product (R9). ``hops(product, a, b, runs)``, ``paths(a, b, path)``."""
    return hops.join(paths, ["a", "b"]).select("product", F.explode("path").alias("piece"), "runs").groupBy("product", "piece").agg(F.sum("runs").alias("runs"))


def spur_loads(hops: DataFrame) -> DataFrame:
    """The busiest hop at each stop by product."""
    ends = hops.select("product", F.explode(F.array("a", "b")).alias("stop"), "runs")
    return ends.groupBy("product", "stop").agg(F.max("runs").alias("runs"))

