"""Readers of raw public files as DataFrames."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis.functions.keys import is_metropolitan, normalise_code
from zonalis.operators.dedup import totals_only
from zonalis.runtime import broadcast_if_small, cut, shuffle_partitions

BOM = "﻿"


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8", quote: str = '"') -> DataFrame:
    """All columns as strings, blanks as NULL, byte-order marks off the header names."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, quote=quote, inferSchema=False, nullValue="")
    return df.toDF(*[c.replace(BOM, "").replace("ï»¿", "").strip() for c in df.columns])


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(file, place, line)`` of text files; blank lines go. ``place`` grows along a file.

    Files are split like any text: ``place`` is the split's start and the line's number within its task.
    """
    reader = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).option("maxCharsPerColumn", -1).option("nullValue", "\u0002")
    rows = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "line")
    return rows.select("file", F.struct("start", F.monotonically_increasing_id().alias("at")).alias("place"), "line")


def read_after_preamble(spark: SparkSession, path: str, header_prefix: str, columns: Sequence[str], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Rows below the first line that starts with ``header_prefix``, file by file (S2); files without one give none.

    A first pass keeps each file's header and its place, a row a file; the second reads the lines in splits and drops
    those that don't lie below. ``columns`` picks header names in order.
    """
    lines = read_lines(spark, path, encoding)
    plain = F.replace("line", F.lit(BOM), F.lit(""))
    heads = lines.where(F.startswith(plain, F.lit(header_prefix))).groupBy("file").agg(F.min(F.struct("place", plain.alias("line"))).alias("h"))
    heads = cut(heads.select(F.col("file").alias("of"), F.col("h.place").alias("from"), F.transform(F.split("h.line", re.escape(sep)), lambda h: F.trim(h)).alias("header")))
    rows = lines.join(broadcast_if_small(heads, 100_000), F.col("file") == F.col("of")).where((F.col("place") > F.col("from")) & (F.trim("line") != ""))
    cells = F.split("line", re.escape(sep))
    pick = lambda c: F.nullif(F.trim(F.get(cells, F.array_position("header", c).cast("int") - 1)), F.lit(""))
    return rows.select(*[pick(c).alias(c) for c in columns])


def read_commented_grid(spark: SparkSession, path: str, fields: Mapping[str, int], least: int, keep: Column | None = None, sep: str = ";") -> DataFrame:
    """Numeric fields by position from lines without #, with enough fields; unparsable rows go (S3)."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    cells = F.split(F.regexp_replace("value", re.escape(sep) + r"+\s*$", ""), re.escape(sep))
    parsed = lines.withColumn("c", cells).where(F.size("c") >= least)
    parsed = parsed.select("c", *[F.trim(F.get("c", F.lit(i))).try_cast("double").alias(n) for n, i in fields.items()])
    if keep is not None:
        parsed = parsed.where(keep)
    return parsed.drop("c").dropna()


def repeated_blocks(df: DataFrame, cells: str, prefix: int, block: int, names: Sequence[str]) -> DataFrame:
    """One row per block of ``block`` cells after the first ``prefix``; blank blocks go."""
    n = F.floor((F.size(cells) - prefix) / block).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.struct((i + 1).alias("pos"), F.slice(cells, prefix + 1 + i * block, F.lit(block)).alias("b")))
    rows = df.withColumn("__b", F.explode(blocks))
    cell = lambda i: F.nullif(F.trim(F.get("__b.b", F.lit(i))), F.lit(""))
    out = rows.select(*df.columns, F.col("__b.pos").alias("pos"), *[cell(i).alias(n) for i, n in enumerate(names)])
    return out.where(F.coalesce(*names[:block]).isNotNull())


def cube(df: DataFrame, members: Mapping[str, Iterable[str]], geo: str = "GEO", kind: str = "GEO_OBJECT", area_kind: str = "COM") -> DataFrame:
    """Area rows of a statistical cube with every named dimension in its codes; error without a column or row."""
    lacking = [c for c in members if c not in df.columns]
    if lacking:
        raise ValueError(f"the cube has no dimension {lacking}")
    rows = df.where(F.col(kind) == area_kind)
    for dimension, codes in members.items():
        rows = rows.where(F.col(dimension).isin(*codes))
    rows = rows.withColumns({"code": normalise_code(F.col(geo)), "value": F.col("OBS_VALUE").try_cast("double")}).where(F.col("code").isNotNull() & is_metropolitan(F.col("code")))
    if rows.isEmpty():
        raise ValueError("no row of the cube matches")
    return rows


def cube_totals(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """The cube with every dimension outside ``known`` at its total."""
    return totals_only(df, known)


def indicator_values(df: DataFrame, levels: Sequence[str], statistics: Sequence[str], indicator: str) -> DataFrame:
    """``(code, <level>_<statistic>..., origin)`` of a long indicator file; error if another code is inside."""
    kept = df.where(F.col("rechauffement_france").isin(*levels) & F.col("statistique").isin(*statistics))
    other = kept.where(F.col("code_indicateur") != indicator).limit(1).collect()
    if other:
        raise ValueError(f"the file also holds {other[0]['code_indicateur']}")
    cell = F.concat_ws("_", "rechauffement_france", "statistique")
    rows = kept.select(normalise_code(F.col("code_territoire")).alias("code"), cell.alias("cell"), F.col("resultat").try_cast("double").alias("v"), "donnees_issues_territoire")
    names = [f"{level}_{s}" for level in levels for s in statistics]
    wide = rows.groupBy("code").pivot("cell", names).agg(F.first("v", ignorenulls=True))
    origin = rows.groupBy("code").agg(F.first("donnees_issues_territoire", ignorenulls=True).alias("origin"))
    return wide.join(origin, "code")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Elements of top-level JSON arrays in one or many files."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_features(spark: SparkSession, path: str, properties: str, geometry: str = "struct<type:string,coordinates:string>") -> DataFrame:
    """``(properties..., geom_type, coordinates)`` of feature collections (S9); coordinates stay JSON text."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:{geometry}>>"
    pages = spark.read.option("multiLine", True).schema(schema).json(path)
    f = pages.select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def polygon_rings(coordinates: Column, geom_type: Column) -> Column:
    """JSON coordinates of a Polygon or MultiPolygon as an array of rings of {x, y}."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(geom_type == "MultiPolygon", many).otherwise(one)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def open_file(path: str):
    """A file of a shared store as a seekable stream; nothing is read before it is asked for."""
    from pyarrow import fs

    store, name = re.match(r"(?:([a-z][a-z0-9+.-]*):(?://[^/]*)?)?(.*)", path, re.S).groups()
    if store in (None, "file"):
        return fs.LocalFileSystem().open_input_file(name)
    system, _ = fs.FileSystem.from_uri(path[: len(path) - len(name)] + "/")
    return system.open_input_file(name)


def _members(stream) -> tuple[list[str], Callable]:
    """The member names of a zip (from its directory at the end) or tar archive, and how to open one."""
    import tarfile
    import zipfile

    if zipfile.is_zipfile(stream):
        box = zipfile.ZipFile(stream)
        return box.namelist(), box.open
    stream.seek(0)
    box = tarfile.open(fileobj=stream)
    return [m.name for m in box if m.isfile()], box.extractfile


def read_archive_lines(spark: SparkSession, path: str, member: str, latest: bool = False, encoding: str = "utf-8") -> DataFrame:
    """``(archive, member, number, line)`` of zip or tar members whose name matches a pattern.

    Archives of any size: a task opens one where it lies, seeks to the member by the archive's directory and streams its
    lines, so it holds some lines only. Several archives are read in parallel. With ``latest`` the last matching name
    wins, otherwise an archive must have exactly one.
    """

    def run(batches):
        import io

        names = ("archive", "member", "number", "line")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    found, opened = _members(source)
                    hits = sorted(n for n in found if re.search(member, n))
                    if not hits or len(hits) > 1 and not latest:
                        raise ValueError(f"{path}: {len(hits)} members match {member}")
                    with opened(hits[-1]) as stream:
                        rows, size = [], 0
                        for number, line in enumerate(io.TextIOWrapper(stream, encoding=encoding)):
                            rows.append((path, hits[-1], number, line.rstrip("\r\n")))
                            size += len(line)
                            if len(rows) == 20_000 or size > 8 << 20:
                                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
                                rows, size = [], 0
                        if rows:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    # Spark lists the files; their content isn't read here.
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(shuffle_partitions(spark), "path").mapInArrow(run, "archive string, member string, number bigint, line string")


def split_member(lines: DataFrame, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Columns of archive lines below their header, by from_csv so that quotes count.

    Every archive is read by its own header, whatever the order of its columns; one that lacks a column is an error.
    """
    plain = F.replace("line", F.lit(BOM), F.lit(""))
    # One row per archive; the widest header sets the number of cells.
    width = lines.where("number = 0").agg(F.max(F.size(F.split(plain, re.escape(sep))))).first()[0] or 1
    cells = F.from_csv(plain, ", ".join(f"c{i} string" for i in range(width)), {"sep": sep})
    parsed = lines.select("archive", "number", cells.alias("c"))
    listed = F.array(*[F.col(f"c.c{i}") for i in range(width)])
    header = parsed.where("number = 0").select("archive", F.transform(listed, lambda h: F.trim(h)).alias("h"))
    lacking = header.where(functools.reduce(lambda a, b: a | b, [~F.coalesce(F.array_contains("h", c), F.lit(False)) for c in columns])).limit(1).collect()
    if lacking:
        raise ValueError(f"{lacking[0]['archive']} lacks a column of {list(columns)}")
    body = parsed.where("number > 0").join(header, "archive")
    return body.select(*[F.get(listed, F.array_position("h", c).cast("int") - 1).alias(c) for c in columns])


def read_timetable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a timetable feed."""
    names = ("feed_info", "calendar_dates", "trips", "stops", "stop_times")
    return {n: read_delimited(spark, f"{folder}/{n}.txt", sep=",") for n in names}


def grid_window(cells: DataFrame, row: tuple[int, int], col: tuple[int, int], least: float) -> DataFrame:
    """Cells of a window, values below the valid minimum as NULL."""
    inside = cells.where(F.col("row").between(*row) & F.col("col").between(*col))
    return inside.withColumn("value", F.when(F.col("value") >= least, F.col("value")))


def population_cells(df: DataFrame, cell: str = "idcar_200m", people: str = "ind") -> DataFrame:
    """Centres (x, y) and people of 200 m cells named like CRS3035RES200mN...E..., people above 0."""
    out = df.select(F.col(cell).alias("cell"), (F.regexp_extract(cell, r"N\d+E(\d+)$", 1).try_cast("double") + 100.0).alias("x"), (F.regexp_extract(cell, r"N(\d+)E", 1).try_cast("double") + 100.0).alias("y"), F.col(people).try_cast("double").alias("pop"))
    return out.where("pop > 0 and x is not null and y is not null")


def stacked_blocks(lines: DataFrame, n: int) -> DataFrame:
    """Values in the first n numbered lines re-paired with the coordinates in the next n.

    ``lines(number, line)``; error where a coordinate is missing for a value.
    """
    values = lines.where(F.col("number") < n).select("number", F.trim("line").try_cast("double").alias("value"))
    cells = F.split(F.trim("line"), r"[;,\s]+")
    places = lines.where(F.col("number").between(n, 2 * n - 1)).select((F.col("number") - n).alias("number"), cells[0].try_cast("double").alias("x"), F.get(cells, F.lit(1)).try_cast("double").alias("y"))
    paired = values.join(places, "number", "full_outer")
    bad = paired.where("value is not null and (x is null or y is null)").limit(1).collect()
    if bad:
        raise ValueError(f"no place for line {bad[0]['number']}")
    return paired.where("value is not null")

