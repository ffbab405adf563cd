"""Readers and writers on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators import contract as Q
from zonalis.plans.registry import Registry, processed
from zonalis.sources import readers as R
from zonalis.sources import sinks as O


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿code;nom\n01001;Étang\n2A004;\n".encode())
    rows = R.read_delimited(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.collect()] == [("01001", "Étang"), ("2A004", None)]
    (tmp_path / "b.csv").write_bytes("code;nom\n1;Étang\n".encode("latin-1"))
    assert R.read_delimited(spark, str(tmp_path / "b.csv"), encoding="ISO-8859-1").first()["nom"] == "Étang"


def test_header_after_preamble(spark, tmp_path):
    for year, more in ((1, "x\n"), (2, "")):
        (tmp_path / f"f{year}.csv").write_text(f"titre\n{more}\nAnnée;Code INSEE;Surface (m2)\n{year};01001;5\n;;\n")
    rows = R.read_after_preamble(spark, str(tmp_path / "*.csv"), "Année;", ["Année", "Surface (m2)"])
    assert sorted((r[0], r[1]) for r in rows.collect() if r[0]) == [("1", "5"), ("2", "5")]


def test_commented_grid(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# a\n1;2;3;\nx;2;3\n4;5\n7;8;9;;\n")
    rows = R.read_commented_grid(spark, str(tmp_path / "g.txt"), {"lon": 0, "v": 2}, 3)
    assert sorted(map(tuple, rows.collect())) == [(1.0, 3.0), (7.0, 9.0)]


def test_features_and_rings(spark, tmp_path):
    page = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"nom": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"nom": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]]]}},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    rows = R.read_features(spark, str(tmp_path / "p.json"), "nom:string")
    area = rows.select("nom", G.polygon_area(R.polygon_rings(F.col("coordinates"), F.col("geom_type"))).alias("a"))
    assert {r["nom"]: r["a"] for r in area.collect()} == {"A": 0.5, "B": 2.0}


def test_archive_members(spark, tmp_path):
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / f"z{n}.zip", "w") as z:
            z.writestr("data_2020.csv", "a,b\n1,2\n")
            z.writestr("data_2021.csv", f'a,b\n{n},"x, y"\n')
    lines = R.read_archive_lines(spark, str(tmp_path / "*.zip"), r"^data_", latest=True)
    assert sorted(map(tuple, R.split_member(lines, ["a", "b"]).collect())) == [("1", "x, y"), ("2", "x, y")]
    with pytest.raises(Exception, match="members match"):
        R.read_archive_lines(spark, str(tmp_path / "*.zip"), r"^data_").collect()


def test_archives_with_columns_in_another_order(spark, tmp_path):
    for n, text in ((1, "a,b\n1,2\n"), (2, "b,a\n3,4\n"), (3, 'c,"b",a\n0,5,6\n')):
        with zipfile.ZipFile(tmp_path / f"z{n}.zip", "w") as z:
            z.writestr("data.csv", text)
    lines = R.read_archive_lines(spark, str(tmp_path / "*.zip"), r"^data")
    assert sorted(map(tuple, R.split_member(lines, ["a", "b"]).collect())) == [("1", "2"), ("4", "3"), ("6", "5")]
    with pytest.raises(ValueError, match="lacks a column"):
        R.split_member(lines, ["c"])


def test_timetable_and_pages(spark, tmp_path):
    for name, text in {"feed_info": "feed_version\n7\n", "calendar_dates": "service_id,date\ns,20240101\n", "trips": "trip_id,route_id\nt,r\n", "stops": "stop_id,stop_name\n1,A\n", "stop_times": "trip_id,stop_id\nt,1\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = R.read_timetable(spark, str(tmp_path))
    assert set(feed) == {"feed_info", "calendar_dates", "trips", "stops", "stop_times"} and feed["stops"].first()["stop_name"] == "A"
    (tmp_path / "p1.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "p2.json").write_text('[\n{"a": 3}\n]')
    assert sorted(r["a"] for r in R.read_json_array(spark, str(tmp_path / "p*.json"), "a int").collect()) == [1, 2, 3]


def test_wide_join_turns_text_that_is_no_number_into_null(spark):
    from zonalis.operators import joins as J

    base = spark.createDataFrame([("a",), ("b",)], "code string")
    table = spark.createDataFrame([("a", "1.23456"), ("b", "n/a")], "code string, v string")
    assert {r["code"]: r["v"] for r in J.wide_join(base, [table], numeric={"v": "numeric"}).collect()} == {"a": 1.2346, "b": None}


def test_cut_tables_can_be_released(spark):
    from zonalis import runtime

    kept = runtime.cut(spark.range(3))
    assert kept.count() == 3 and runtime.release(spark) >= 1 and runtime.release(spark) == 0


def test_cells_and_stacked_blocks(spark):
    cells = spark.createDataFrame([("CRS3035RES200mN2029800E4254200", "10.5"), ("CRS3035RES200mN0E0", "0")], "idcar_200m string, ind string")
    assert [tuple(r) for r in R.population_cells(cells).collect()] == [("CRS3035RES200mN2029800E4254200", 4254300.0, 2029900.0, 10.5)]
    lines = spark.createDataFrame(list(enumerate(["5", "-", "7", "1 2", "3 4", "5 6"])), "number bigint, line string")
    assert sorted(map(tuple, R.stacked_blocks(lines, 3).collect())) == [(0, 5.0, 1.0, 2.0), (2, 7.0, 5.0, 6.0)]
    with pytest.raises(ValueError, match="no place"):
        R.stacked_blocks(lines.where("number <> 5"), 3)


def test_cube_errors(spark):
    rows = spark.createDataFrame([("01001", "COM", "_T", "5")], "GEO string, GEO_OBJECT string, SEX string, OBS_VALUE string")
    assert R.cube(rows, {"SEX": ["_T"]}).first()["value"] == 5.0
    with pytest.raises(ValueError, match="no dimension"):
        R.cube(rows, {"AGE": ["_T"]})
    with pytest.raises(ValueError, match="no row"):
        R.cube(rows, {"SEX": ["M"]})


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("2", 1.0, None), ("1", 2.0, None)], "code string, a double, b double")
    O.write_stat_columns(df, ["a", "b"], str(tmp_path / "stats"))
    back = spark.read.parquet(str(tmp_path / "stats"))
    assert {(r["field"], r["code"], r["value"]) for r in back.collect()} == {("a", "1", 2.0), ("a", "2", 1.0)}
    O.write_area_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    squares = df.select("code", G.square(F.lit(0.12345678), F.lit(1.0), 0.5).alias("rings"))
    O.write_features(squares, ["code"], str(tmp_path / "features"))
    feature = json.loads(spark.read.text(str(tmp_path / "features")).first()["value"])
    assert feature["geometry"]["coordinates"][0][0] == [0.123457, 1.0]
    docs = O.nested_documents(df, "code", "a", ["b"], F.substring("code", 1, 1))
    O.write_nested_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2


def test_network_documents_have_flags_only_where_set(spark):
    rows = [("p", [1, 2], [0, 5], 3, [0, 0]), ("q", [2, 3], [0, 7], 9, [0, 1])]
    df = spark.createDataFrame(rows, "product string, stops array<int>, times array<int>, runs int, flags array<int>")
    assert [(r["product"], r["flags"]) for r in O.network_documents(df).collect()] == [("q", [0, 1]), ("p", None)]


def test_registry():
    registry = Registry()

    @registry.source("a", "commune_table", fields={"x": "numeric"})
    def a():
        raise AssertionError

    with pytest.raises(ValueError, match="twice"):
        registry.source("a", "commune_table")
    with pytest.raises(ValueError, match="kind"):
        registry.source("b", "table")
    with pytest.raises(KeyError):
        registry.build("none", {})
    with pytest.raises(ValueError, match="declared"):
        processed(None, "x", "a", ())


def test_gate(spark):
    Q.gate(spark.range(0), "fine")
    with pytest.raises(ValueError, match="bad"):
        Q.gate(spark.range(1), "bad")
    assert Q.long_names(["abc", "abcdefghijk"]) == ["abcdefghijk"]


def test_preamble_files_are_split(spark, tmp_path):
    """Files of many splits: lines below each file's own header, in any encoding, header-like lines below it as data."""
    for name, encoding, n in (("a", "UTF-8", 4000), ("b", "UTF-8", 7)):
        head = ["Titre", "", "Année;Surface", "Année;9"] if name == "a" else ["Surface;Année"]
        rows = [f"{1990 + i % 9};{i}" if name == "a" else f"{i};{1990 + i % 9}" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\r\n".join([*head, *rows]), encoding=encoding)
    (tmp_path / "c.csv").write_text("no header;here\n1;2")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = R.read_after_preamble(spark, str(tmp_path / "a.csv"), "Année;", ["Surface", "Année"])
        assert got.rdd.getNumPartitions() > 5
        assert sorted((int(r[0]), r[1]) for r in got.collect()) == sorted([(9, "Année"), *[(i, str(1990 + i % 9)) for i in range(4000)]])
        assert R.read_after_preamble(spark, str(tmp_path / "b.csv"), "Surface;", ["Année"]).count() == 7
        assert R.read_after_preamble(spark, str(tmp_path / "c.csv"), "Surface;", ["Année"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "latin.csv").write_bytes("x\nAnnée;Été\n1;à\n".encode("latin-1"))
    assert [tuple(r) for r in R.read_after_preamble(spark, str(tmp_path / "latin.csv"), "Année;", ["Été"], encoding="ISO-8859-1").collect()] == [("à",)]


def test_archives_of_more_than_two_gigabytes(spark, tmp_path):
    """The archive follows a hole of 2.5 GB, so nothing but its directory and member may be read."""
    import tarfile
    import zipfile

    path = tmp_path / "large file.zip"
    with open(path, "wb") as f:
        f.seek(2_500_000_000)
        f.write(b"x")
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data_1.csv", "a,b\n1,2\n")
        z.writestr("other.csv", "no")
    with tarfile.open(tmp_path / "small.tar.gz", "w:gz") as t:
        (tmp_path / "data_2.csv").write_text("a,b\n3,4\n")
        t.add(tmp_path / "data_2.csv", "in/data_2.csv")
    lines = R.read_archive_lines(spark, f"{tmp_path}/*.{{zip,gz}}", r"data_\d")
    assert sorted((r["member"], r["number"], r["line"]) for r in lines.collect()) == [("data_1.csv", 0, "a,b"), ("data_1.csv", 1, "1,2"), ("in/data_2.csv", 0, "a,b"), ("in/data_2.csv", 1, "3,4")]
    assert "content" not in lines._jdf.queryExecution().executedPlan().toString().replace("read_archive", "")
