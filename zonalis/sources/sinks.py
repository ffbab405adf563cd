"""Writers of published outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.keys import finite, finite_of
from zonalis.operators.ranking import distributed_row_number
from zonalis.runtime import broadcast_if_small, shuffle_partitions, tasks_for


def write_area_table(df: DataFrame, path: str, key: str = "code") -> None:
    """Parquet, globally sorted by key (O1)."""
    df.orderBy(key).write.mode("errorifexists").parquet(path)


def feature_json(properties: Sequence[str], geom_type: str, coordinates: Column) -> Column:
    """One GeoJSON feature per row; coordinates are arrays, six decimals (O2)."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(f',"geometry":{{"type":"{geom_type}","coordinates":'), F.to_json(coordinates), F.lit("}}"))


def rounded_rings(rings: Column, digits: int = 6) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))


def write_features(df: DataFrame, properties: Sequence[str], path: str, rings: str = "rings") -> None:
    """Polygons as newline-delimited features (O2)."""
    df.select(feature_json(properties, "Polygon", rounded_rings(F.col(rings))).alias("value")).write.text(path)


def stat_columns(df: DataFrame, columns: Sequence[str], key: str = "code") -> DataFrame:
    """``(field, key, value)`` of every numeric column that has any value; NaN and infinities are NULL (O3)."""
    slim = df.select(key, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    present = slim.agg(*[F.count(c).alias(c) for c in columns]).first().asDict() if columns else {}
    kept = [c for c in columns if present[c]]
    slim = slim.select(key, *kept)
    return slim.unpivot(key, kept, "field", "value")


def coverage(df: DataFrame, columns: Sequence[str], thin: float = 0.25) -> DataFrame:
    """``(field, n, share, thin)`` of each column; NaN and infinities don't count (O3)."""
    row = df.agg(F.count("*").alias("__n"), *[F.count(finite_of(df, c)).alias(c) for c in columns])
    items = [F.struct(F.lit(c).alias("field"), F.col(c).alias("n"), F.try_divide(F.col(c), F.col("__n")).alias("share")) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*").withColumn("thin", F.col("share") < thin)


def write_stat_columns(df: DataFrame, columns: Sequence[str], path: str, key: str = "code") -> None:
    """One folder per column, in files of consecutive keys, so a reader fetches the columns it needs (O3).

    Rows are dealt to ranges of (column, key): a column of many rows is several tasks' work and several files.
    """
    long = stat_columns(df, columns, key)
    ordered = long.repartitionByRange(shuffle_partitions(df.sparkSession), "field", key).sortWithinPartitions("field", key)
    ordered.write.partitionBy("field").parquet(path)


def nested_documents(rows: DataFrame, key: str, order: str, values: Sequence[str], dep: Column) -> DataFrame:
    """``(dep, key, rows)``: an area's rows as one sorted array."""
    item = F.struct(order, *values)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows")).withColumn("dep", dep)


def write_nested_documents(documents: DataFrame, path: str) -> None:
    """One folder per department, in files of consecutive keys."""
    keys = [c for c in documents.columns if c not in ("dep", "rows")]
    documents.repartitionByRange(shuffle_partitions(documents.sparkSession), "dep", *keys).write.partitionBy("dep").json(path)


def network_documents(patterns: DataFrame) -> DataFrame:
    """Patterns by runs descending with flags only where any is set (O5). ``patterns(product, stops, times, runs, flags)``."""
    flags = F.when(F.exists("flags", lambda f: f != 0), F.col("flags"))
    return patterns.select("product", "stops", "times", "runs", flags.alias("flags")).orderBy(F.col("runs").desc(), "product", "stops")


def network_stops(patterns: DataFrame, areas: DataFrame, names: DataFrame) -> DataFrame:
    """``(number, stop, name, lon, lat)``: every stop of the patterns numbered from 0 in order of its code.

    ``areas(stop, name, lon, lat)``, ``names(stop, name)`` whose names go first. A stop without an area has its code
    for a name and no place.
    """
    stops = patterns.select(F.explode("stops").alias("stop")).distinct()
    numbered = distributed_row_number(stops, [F.col("stop")], "number").withColumn("number", F.col("number") - 1)
    joined = numbered.join(areas.withColumnRenamed("name", "area"), "stop", "left").join(names, "stop", "left")
    name = F.when(F.col("lon").isNull(), F.col("stop").cast("string")).otherwise(F.coalesce("name", "area"))
    return joined.select("number", "stop", name.alias("name"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


#: Numbered stops up to so many go to every task.
BROADCAST_STOPS = 200_000


def numbered_patterns(documents: DataFrame, stops: DataFrame) -> DataFrame:
    """network_documents() rows with ``stops`` as numbers of network_stops()."""
    tasks, order = tasks_for(documents), [F.col("runs").desc(), F.col("product"), F.col("stops")]
    placed = documents.withColumn("__d", F.xxhash64("product", "stops")).select("*", F.posexplode("stops").alias("__at", "stop")).join(broadcast_if_small(stops.select("stop", "number"), BROADCAST_STOPS), "stop")
    keys = ["__d", "product", "times", "runs", "flags"]
    # Dealt by their number, so neither the groups nor the sort of a task grow with the patterns.
    rows = placed.repartition(tasks, "__d").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "number"))).alias("s"))
    return rows.select("product", F.col("s.number").alias("stops"), "times", "runs", "flags").repartitionByRange(tasks, *order).sortWithinPartitions(*order)


#: Draw order of layer types.
DRAW_ORDER = {"fill": 10, "raster": 20, "line": 30, "circle": 40}


def layer_catalogue(layers: DataFrame) -> DataFrame:
    """Layers with default opacity, visibility and draw order, in drawing order.

    ``layers(source, source_order, pos, layer, type, opacity, visible, attribution)``.
    """
    z = F.coalesce(*[F.when(F.col("type") == t, F.lit(n)) for t, n in DRAW_ORDER.items()], F.lit(10))
    filled = layers.withColumns({"opacity": F.coalesce("opacity", F.lit(1.0)), "visible": F.coalesce("visible", F.lit(False)), "z": z})
    return filled.orderBy("z", "source_order", "source", "pos")
