"""Quickest ways over a track graph, bounded by the places that are wanted.

A network of a checked size goes to every task, and the sources are dealt out: each is a search that ends when its wanted
places are settled. A larger network stays where it is: chains of pieces are contracted into shortcuts, all sources
relax at once in jobs of several steps, and ways are read off links to the place before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.operators.graph_components import connected_components
from zonalis.runtime import cut, shuffle_partitions

#: Relaxations of one job.
UNROLLED = 6
#: Networks of up to so many pieces, of some 100 bytes each, go to every task.
BROADCAST_EDGES = 200_000


def contracted(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed shortcuts ``(chain, src, dst, plain, fast, k)`` and ``(chain, at, piece, length)`` of their pieces.

    ``edges(src, dst, piece, seconds, lgv, length)`` are undirected; ``kept(node)`` stay nodes. Every other node of
    exactly two edges lies inside a chain of pieces, which one shortcut from end to end replaces: ``plain`` and ``fast``
    seconds and ``k`` pieces, ``at`` from 1. Each arc's distance to its chain's end is found by doubling, so a chain of
    n pieces takes log2(n) rounds. Chains from a node to itself and rings without a kept node are on no quickest way.
    """
    way = edges.where("src <> dst").select(
        "piece", "src", "dst", F.when(F.col("lgv"), F.lit(0.0)).otherwise(F.col("seconds")).alias("plain"), F.when(F.col("lgv"), F.col("seconds")).otherwise(F.lit(0.0)).alias("fast"), "length")
    # A table, so that the two directions number the same rows alike.
    way = cut(way.withColumn("edge", F.monotonically_increasing_id()))
    back = way.select("piece", F.col("dst").alias("src"), F.col("src").alias("dst"), "plain", "fast", "length", "edge")
    arcs = way.withColumn("turn", F.lit(0)).unionByName(back.withColumn("turn", F.lit(1)))
    arcs = arcs.withColumn("arc", F.col("edge") * 2 + F.col("turn")).drop("turn")
    inner = cut(arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")).where("d = 2").join(kept.select("node").distinct(), "node", "left_anti").select("node"))
    state = arcs.join(inner, arcs["dst"] == inner["node"], "left").select("arc", "edge", "piece", "length", "src", "dst", "plain", "fast", F.lit(1).cast("bigint").alias("k"), F.col("node").isNotNull().alias("open"), F.col("arc").alias("last"), F.col("edge").alias("last_edge"))
    if not inner.isEmpty():
        state = cut(state)
        after = state.select(F.col("src").alias("dst"), F.col("arc").alias("n_arc"), F.col("edge").alias("n_edge"))
        # The next arc leaves the inner node by its other edge.
        onward = state.where("open").select("arc", F.col("dst"), "edge").join(after, "dst").where("edge <> n_edge").select("arc", F.col("n_arc").alias("next"))
        state = cut(state.join(onward, "arc", "left").drop("last_edge"))
        most = state.count()
        steps = 1
        while steps < 2 * most and not state.where("open").isEmpty():
            ahead = state.select(
                F.col("arc").alias("next"), F.col("dst").alias("dst2"), F.col("plain").alias("plain2"), F.col("fast").alias("fast2"), F.col("k").alias("k2"), F.col("open").alias("open2"), F.col("last").alias("last2"), F.col("next").alias("next2"))
            both = state.join(ahead, "next", "left")
            on = lambda c: F.when(F.col("open"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
            add = lambda c: F.when(F.col("open"), F.col(c) + F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
            state = cut(both.select("arc", "piece", "length", "src", on("dst"), add("plain"), add("fast"), add("k"), on("last"), on("open"), F.when(F.col("open"), F.col("next2")).otherwise(F.col("next")).alias("next")))
            steps *= 2
        state = state.where("not open")
    heads = state.join(inner, state["src"] == inner["node"], "left_anti").where("src <> dst")
    shortcuts = cut(heads.select(F.col("last").alias("chain"), "src", "dst", "plain", "fast", "k"))
    parts = state.select(F.col("last").alias("chain"), F.col("k").alias("left"), "piece", "length").join(shortcuts.select("chain", "k"), "chain")
    return shortcuts, cut(parts.select("chain", (F.col("k") - F.col("left") + 1).alias("at"), "piece", "length"))


LABEL = ("cost", "n", "prev", "chain")


def _least() -> Column:
    return F.min(F.struct(*LABEL)).alias("m")


def labels(shortcuts: DataFrame, sources: DataFrame, wanted: DataFrame | None, unrolled: int = UNROLLED) -> DataFrame:
    """``(source, penalty, node, cost, n, prev, chain)``: the best way to each node, as a link to the node before.

    ``shortcuts`` of contracted(), ``sources(source, penalty)``. A job relaxes ``unrolled`` times; only nodes that got
    better start the next one, and only they are written, so what is settled is never written again. With
    ``wanted(source, penalty, node)`` a node dearer than all wanted ones of its source, once these are reached, goes no
    further. Ties go to fewer pieces, then the smaller node before.
    """
    key = ["source", "penalty", "node"]
    weight = F.col("plain") + F.col("fast") * F.col("penalty")
    step = shortcuts.select(F.col("src").alias("node"), F.col("dst"), "plain", "fast", F.col("k"), F.col("chain").alias("by"))
    # A node also steps to itself, so one join both keeps and spreads what is known.
    nodes = shortcuts.select(F.col("src").alias("node")).distinct()
    stay = nodes.select("node", F.col("node").alias("dst"), F.lit(0.0).alias("plain"), F.lit(0.0).alias("fast"), F.lit(0).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("by"))
    step = cut(step.unionByName(stay))
    node_type = shortcuts.schema["src"].dataType
    front = sources.select("source", "penalty", F.col("source").cast(node_type).alias("node"), F.lit(0.0).alias("cost"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(node_type).alias("prev"), F.lit(None).cast("bigint").alias("chain")).distinct()
    front = cut(front)
    layers, bound = [front], None
    while True:
        rows = front
        for _ in range(unrolled):
            moved = F.col("by").isNotNull()
            rows = rows.join(step, "node").select(
                "source", "penalty", F.col("dst").alias("to"), (F.col("cost") + weight).alias("cost"), (F.col("n") + F.col("k")).alias("n"), F.when(moved, F.col("node")).otherwise(F.col("prev")).alias("prev"), F.coalesce("by", "chain").alias("chain"))
            rows = rows.withColumnRenamed("to", "node").groupBy(*key).agg(_least()).select(*key, "m.*")
        if bound is not None:
            rows = rows.join(bound, ["source", "penalty"], "left").where("bound is null or cost <= bound").drop("bound")
        known = reduce(DataFrame.unionByName, layers).groupBy(*key).agg(F.min(F.struct(*LABEL)).alias("old"))
        order = lambda at: F.struct(F.col(f"{at}cost").alias("cost"), F.col(f"{at}n").alias("n"), F.coalesce(f"{at}prev", "node").alias("prev"))
        better = rows.join(known, key, "left").where(F.col("old").isNull() | (order("") < order("old.")))
        front = cut(better.select(*key, *LABEL))
        if front.isEmpty():
            break
        layers.append(front)
        if wanted is not None:
            # The dearest wanted node of each source whose wanted nodes all have a way.
            seen = wanted.join(reduce(DataFrame.unionByName, layers).select(*key, "cost"), key, "left").groupBy(*key).agg(F.min("cost").alias("cost"))
            bound = cut(seen.groupBy("source", "penalty").agg(F.max("cost").alias("bound"), F.count_if(F.col("cost").isNull()).alias("open")).where("open = 0").drop("open"))
            front = front.join(bound, ["source", "penalty"], "left").where("bound is null or cost <= bound").drop("bound")
    return cut(reduce(DataFrame.unionByName, layers).groupBy(*key).agg(_least()).select(*key, "m.*"))


def ways(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, penalty, node, chain, n)``: every shortcut on the way to each wanted node, ``n`` pieces at its end.

    Links to the node before are doubled and marked from the longest down, so a way of m shortcuts takes 2 log2(m) joins.
    """
    key = ["source", "penalty"]
    jump = cut(found.where("prev is not null").select(*key, F.col("node").alias("at"), F.col("prev").alias("to")))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        ahead = jump.select(*key, F.col("at").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(ahead, [*key, "to"]).select(*key, "at", F.col("further").alias("to")))
    marked = wanted.select(*key, "node", F.col("node").alias("at"))
    for jump in reversed(jumps):
        marked = cut(marked.unionByName(marked.join(jump, [*key, "at"]).select(*key, "node", F.col("to").alias("at"))))
    links = found.where("prev is not null").select(*key, F.col("node").alias("at"), "chain", "n")
    return marked.join(links, [*key, "at"]).select(*key, "node", "chain", "n")


def searched(near: dict, source, penalty: float, wanted: Iterable | None) -> dict:
    """Node -> (cost, pieces, node before, piece, metres) of the nodes settled until all ``wanted`` ones are.

    ``near``: node -> (node, plain seconds, fast seconds, piece, metres). Ties go to fewer pieces, then the smaller node
    before, then the smaller piece.
    """
    open_ = None if wanted is None else set(wanted)
    best, settled, heap = {source: (0.0, 0, None, None, 0.0)}, {}, [(0.0, 0, source)]
    while heap and (open_ is None or open_):
        cost, n, node = heapq.heappop(heap)
        if node in settled:
            continue
        settled[node] = best[node]
        if open_ is not None:
            open_.discard(node)
        for to, plain, fast, piece, metres in near.get(node, ()):
            if to in settled:
                continue
            c, old = cost + (plain + fast * penalty), best.get(to)
            if old is None or (c, n + 1, node, piece) < old[:4]:
                best[to] = (c, n + 1, node, piece, metres)
                if old is None or (c, n + 1) < old[:2]:
                    heapq.heappush(heap, (c, n + 1, to))
    return settled


def _by_source(tracks: DataFrame, sources: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """quickest() with the whole network in every task; ``sources`` and ``wanted`` carry ``penalty``."""
    key = ["source", "penalty"]
    rows = [tuple(r) for r in tracks.select("src", "dst", "seconds", "lgv", "piece", "length").collect()]
    held = tracks.sparkSession.sparkContext.broadcast(rows)
    asked = sources.withColumn("nodes", F.lit(None).cast(f"array<{tracks.schema['src'].dataType.simpleString()}>"))
    if wanted is not None:
        # A source has as many rows as the network has nodes at most.
        asked = wanted.groupBy(*key).agg(F.collect_set("node").alias("nodes"))

    def run(batches):
        near: dict = {}
        for a, b, seconds, lgv, piece, metres in held.value:
            way = (0.0, seconds) if lgv else (seconds, 0.0)
            near.setdefault(a, []).append((b, *way, piece, metres))
            near.setdefault(b, []).append((a, *way, piece, metres))
        for batch in batches:
            for source, penalty, nodes in zip(batch["source"], batch["penalty"], batch["nodes"]):
                found = searched(near, source, penalty, nodes)
                out = []
                for node in found if nodes is None else [n for n in nodes if n in found]:
                    path, metres, at = [], 0.0, node
                    while found[at][3] is not None:
                        path.append(found[at][3])
                        metres += found[at][4]
                        at = found[at][2]
                    out.append((source, penalty, node, found[node][0], metres, path[::-1]))
                if out:
                    yield pd.DataFrame(out, columns=["source", "penalty", "node", "cost", "metres", "path"])

    kind = lambda c: sources.schema[c].dataType.simpleString()
    schema = f"source {kind('source')}, penalty double, node {tracks.schema['src'].dataType.simpleString()}, cost double, metres double, path array<bigint>"
    return asked.repartition(shuffle_partitions(tracks.sparkSession), *key).mapInPandas(run, schema)


def quickest(edges: DataFrame, sources: DataFrame, penalty: float = 1.0, wanted: DataFrame | None = None, most: int = BROADCAST_EDGES) -> DataFrame:
    """``(source, node, cost, metres, path)``: quickest way from every source over undirected edges.

    ``edges(src, dst, piece, seconds, lgv, length)``, ``sources(source)``; high-speed edges cost ``penalty`` times their
    seconds. Sources may bring a ``penalty`` of their own each, which the result then carries too. ``wanted(source, node)``
    (and ``penalty``) asks for these ways alone: the search then stops at the dearest wanted node of a source, and wanted
    nodes on other parts of the network are left out from the start. Ties go to the shorter list of pieces, then the
    smaller node before. Networks of more than ``most`` pieces are searched where they lie, with the same result but
    for the order of sums. Negative seconds are an error.
    """
    own = "penalty" in sources.columns
    if not own:
        sources = sources.withColumn("penalty", F.lit(float(penalty)))
        wanted = None if wanted is None else wanted.withColumn("penalty", F.lit(float(penalty)))
    sources = cut(sources.select("source", F.col("penalty").cast("double").alias("penalty")).where("source is not null").distinct())
    tracks = cut(edges.select("src", "dst", F.col("piece").cast("bigint").alias("piece"), "seconds", F.coalesce("lgv", F.lit(False)).alias("lgv"), "length").where("src is not null and dst is not null"))
    if not tracks.where("seconds < 0").isEmpty():
        raise ValueError("an edge takes less than no time")
    key = ["source", "penalty"]
    if wanted is not None:
        wanted = cut(wanted.select("source", F.col("penalty").cast("double").alias("penalty"), "node").where("source is not null and node is not null").distinct())
    if tracks.limit(most + 1).count() <= most:
        out = _by_source(tracks.where("src <> dst"), sources, wanted)
        return out if own else out.drop("penalty")
    kept = sources.select(F.col("source").alias("node"))
    if wanted is None:
        ends = tracks.select(F.col("src").alias("node")).unionByName(tracks.select(F.col("dst").alias("node")))
        kept = kept.unionByName(ends)
    else:
        part = cut(connected_components(tracks))
        of = part.select(F.col("node").alias("source"), F.col("component").alias("home"))
        asked = wanted.join(of, "source", "left").join(part, "node", "left").where("source = node or home = component")
        wanted = cut(asked.select(*key, "node"))
        sources = cut(sources.join(wanted, key, "left_semi"))
        kept = kept.unionByName(wanted.select("node"))
    shortcuts, parts = contracted(tracks, kept)
    found = labels(shortcuts, sources, wanted)
    asked = found.select(*key, "node") if wanted is None else wanted
    at = ways(found, asked).join(parts.withColumnRenamed("at", "place"), "chain").join(shortcuts.select("chain", "k"), "chain")
    at = at.groupBy(*key, "node").agg(F.array_sort(F.collect_list(F.struct((F.col("n") - F.col("k") + F.col("place")).alias("at"), "piece"))).alias("p"), F.sum("length").alias("metres"))
    reached = found.join(asked, [*key, "node"], "left_semi") if wanted is not None else found
    out = reached.join(at, [*key, "node"], "left")
    path = F.coalesce(F.col("p.piece"), F.array().cast("array<bigint>"))
    return out.select("source", *(["penalty"] if own else []), "node", "cost", F.coalesce("metres", F.lit(0.0)).alias("metres"), path.alias("path"))
