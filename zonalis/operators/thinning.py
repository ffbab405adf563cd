"""Coordinate thinning of lines to a tolerance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators.ranking import distributed_row_number
from zonalis.runtime import cut, tasks_for


def keep_mask(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that stay: ends, and recursively the farthest from the chord while beyond the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = np.hypot(dx, dy)
        away = np.abs(px * dy - py * dx) / length if length > 0 else np.hypot(px, py)
        far = int(away.argmax())
        if away[far] > tolerance:
            mid = a + 1 + far
            keep[mid] = True
            todo += [(a, mid), (mid, b)]
    return keep


def keep_masks(starts: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """keep_mask() of many lines that lie one behind the other from ``starts`` on: a round splits the chords of all."""
    keep = np.zeros(len(x), bool)
    a, b = np.asarray(starts), np.append(starts[1:], len(x)) - 1
    keep[a] = keep[b] = True
    while True:
        inner = b - a >= 2
        a, b = a[inner], b[inner]
        if not len(a):
            return keep
        n = b - a - 1
        first = np.cumsum(n) - n
        chord = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(chord)) + (a + 1 - first)[chord]
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[at] - x[a][chord], y[at] - y[a][chord]
        length = np.hypot(dx, dy)
        with np.errstate(divide="ignore", invalid="ignore"):
            away = np.where(length[chord] > 0, np.abs(px * dy[chord] - py * dx[chord]) / length[chord], np.hypot(px, py))
        top = np.maximum.reduceat(away, first)
        split = top > tolerance
        tops = np.flatnonzero((away == top[chord]) & split[chord])
        mid = at[tops[np.diff(chord[tops], prepend=-1) > 0]]
        keep[mid] = True
        a, b = np.concatenate([a[split], mid]), np.concatenate([mid, b[split]])


def _whole_lines(placed: DataFrame, tolerance: float) -> DataFrame:
    """Lines that fit a task, each thinned where its points come together in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def thin(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            mask = keep_masks(starts, rows["x"].to_numpy(), rows["y"].to_numpy(), tolerance)
            yield from rows.filter(pa.array(mask)).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            line = batch["line"]
            # Points of the last line so far wait for the rest of it.
            if held and held[-1]["line"][-1] != line[0]:
                yield from thin(*_with_starts(pa.Table.from_batches(held)))
                held = []
            rest = _with_starts(pa.Table.from_batches([batch]))[1][-1]
            if rest:
                yield from thin(*_with_starts(pa.Table.from_batches([*held, batch.slice(0, rest)])))
                held = []
            held.append(batch.slice(rest))
        if held:
            yield from thin(*_with_starts(pa.Table.from_batches(held)))

    ordered = placed.where("line is not null").repartition(tasks_for(placed), "line").sortWithinPartitions("line", "__pos")
    return ordered.mapInArrow(run, placed.schema).select("line", F.col("__pos").alias("pos"), "x", "y")


def _with_starts(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows, and where each of their lines starts."""
    codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in rows["line"].dictionary_encode().unify_dictionaries().chunks])
    return rows, np.flatnonzero(np.diff(codes, prepend=-1))


#: Points between the ends of a chord that one task thins; longer chords are halved by distributed rounds.
PART = 100_000


def thinned(points: DataFrame, tolerance: float, part: int = PART) -> DataFrame:
    """``points(line, pos, x, y)`` without those that lie within the tolerance of their line, as ``(line, pos, x, y)``.

    ``pos``, of any type that has an order, is not repeated in a line. Lines of at most ``part`` points between their ends
    are thinned where their points come together, many at once. Of longer ones a chord with more than ``part`` points between its ends is split
    at its farthest point, found by a grouped maximum; what is left is thinned a chord to a task. Both do what thinning
    the whole line at once does, whatever its length. Points without coordinates go.
    """
    kind = points.schema["line"].dataType.simpleString()
    placed = points.select("line", F.col("pos").alias("__pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    long_lines = cut(placed.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > part + 2).select("line"))
    if long_lines.isEmpty():
        return _whole_lines(placed, tolerance)
    short = _whole_lines(placed.join(long_lines, "line", "left_anti"), tolerance)
    placed = placed.join(long_lines, "line", "left_semi")
    rows = cut(distributed_row_number(placed, [F.col("line"), F.col("__pos")], "pos"))
    names_of = rows.select("line", "pos", "__pos")
    rows = rows.drop("__pos")
    ends = rows.groupBy("line").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = cut(rows.join(ends, "line"))
    kept = ends.select("line", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("pos"))
    inner = rows.where("pos > lo and pos < hi")
    while True:
        long = cut(inner.groupBy("line", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") > part).select("line", "lo", "hi"))
        if long.isEmpty():
            break
        corner = lambda at: rows.select(F.col("line").alias("line"), F.col("pos").alias(at), F.struct("x", "y").alias(at + "_p"))
        chords = long.join(corner("lo"), ["line", "lo"]).join(corner("hi"), ["line", "hi"])
        dx, dy = F.col("hi_p.x") - F.col("lo_p.x"), F.col("hi_p.y") - F.col("lo_p.y")
        px, py = F.col("x") - F.col("lo_p.x"), F.col("y") - F.col("lo_p.y")
        length = F.hypot(dx, dy)
        away = F.when(length > 0, F.abs(px * dy - py * dx) / length).otherwise(F.hypot(px, py))
        measured = inner.join(chords, ["line", "lo", "hi"]).select("line", "lo", "hi", "pos", away.alias("away"))
        top = measured.groupBy("line", "lo", "hi").agg(F.max("away").alias("far"), F.min_by("pos", F.struct((-F.col("away")).alias("a"), "pos")).alias("mid"))
        top = cut(top)
        split = top.where(F.col("far") > tolerance).select("line", "lo", "hi", "mid")
        kept = kept.unionByName(split.select("line", F.col("mid").alias("pos")))
        whole = inner.join(long, ["line", "lo", "hi"], "left_anti")
        parts = inner.join(split, ["line", "lo", "hi"]).where("pos <> mid")
        parts = parts.select("line", "pos", "x", "y", F.when(F.col("pos") < F.col("mid"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(F.col("pos") < F.col("mid"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        inner = cut(whole.select("line", "pos", "x", "y", "lo", "hi").unionByName(parts))
    # The ends of a chord are thinned with its inner points.
    spans = inner.select("line", "lo", "hi").distinct()
    at = lambda end: spans.withColumn("pos", F.col(end)).join(rows.select("line", "pos", "x", "y"), ["line", "pos"])
    names = ["line", "lo", "hi", "pos", "x", "y"]
    whole = inner.select(*names).unionByName(at("lo").select(*names)).unionByName(at("hi").select(*names))

    def thin(chord: pd.DataFrame) -> pd.DataFrame:
        chord = chord.sort_values("pos")
        return chord[keep_mask(chord["x"].to_numpy(float), chord["y"].to_numpy(float), tolerance)][["line", "pos"]]

    stay = kept.unionByName(whole.groupBy("line", "lo", "hi").applyInPandas(thin, f"line {kind}, pos bigint")).distinct()
    out = rows.select("line", "pos", "x", "y").join(stay, ["line", "pos"], "left_semi").join(names_of, ["line", "pos"])
    return short.unionByName(out.select("line", F.col("__pos").alias("pos"), "x", "y"))
