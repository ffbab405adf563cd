"""Source and sink queries (S, O): the given tables are written as raw files in the shared folder and read back."""

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators import aggregates as A
from zonalis.operators.ranking import distributed_row_number
from zonalis.plans import feature_pipelines as Q
from zonalis.plans.catalogue import query
from zonalis.plans.q_joins import squares
from zonalis.plans.registry import processed
from zonalis.runtime import cut, fresh_path
from zonalis.sources import readers as R
from zonalis.sources import sinks as O


def page_of(key, size=500):
    return F.floor((F.col(key) - 1) / size)


def paged(rows, kind, first, last=()):
    """Writes ``rows(page, ord, value)`` as one text file a page, in order between fixed first and last lines."""
    path = fresh_path(rows.sparkSession, kind)
    pages = rows.select("page").distinct()
    for at, lines in ((-1_000_000, first), (1 << 60, last)):
        for i, line in enumerate(lines):
            rows = rows.unionByName(pages.select("page", F.lit(at + i).cast("bigint").alias("ord"), F.lit(line).alias("value")))
    rows.repartition("page").sortWithinPartitions("page", "ord").select("page", "value").write.partitionBy("page").text(path)
    return path + "/page=*"


@query("s1_delimited_text", "select c_custkey::varchar as code, c_name as nom, case when c_custkey % 3 > 0 then c_nationkey::varchar end as dep from {customer}")
def _(v):
    path = fresh_path(v.spark, "delimited")
    rows = v.customer.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("nom"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("dep"))
    rows.write.csv(path, sep=";", header=True)
    return R.read_delimited(v.spark, path)


@query("s2_header_after_preamble", "select (1990 + c_custkey % 9)::varchar as annee, (c_custkey * 3)::varchar as surface from {customer}")
def _(v):
    k = F.col("c_custkey")
    line = F.concat_ws(";", (1990 + k % 9).cast("string"), F.lit("01001"), (k * 3).cast("string"))
    path = paged(v.customer.select(page_of("c_custkey").alias("page"), k.cast("bigint").alias("ord"), line.alias("value")), "preamble", ["Titre", "", "Année;Code INSEE;Surface (m2)"])
    rows = R.read_after_preamble(v.spark, path, "Année;", ["Année", "Surface (m2)"])
    return rows.toDF("annee", "surface")


@query("s3_commented_grid", "select (c_custkey % 100)::double as lon, (c_custkey % 31)::double as lat, c_acctbal as value from {customer} where c_custkey % 5 > 0 and c_custkey % 7 > 0")
def _(v):
    k = F.col("c_custkey")
    full = F.concat_ws(";", (k % 100).cast("string"), (k % 31).cast("string"), F.col("c_acctbal").cast("string"), F.lit(";"))
    line = F.when(k % 5 == 0, "x;1;2;").when(k % 7 == 0, "1;2;").otherwise(full)
    path = paged(v.customer.select(page_of("c_custkey").alias("page"), k.cast("bigint").alias("ord"), line.alias("value")), "grid", ["# lon;lat;value"])
    return R.read_commented_grid(v.spark, path, {"lon": 0, "lat": 1, "value": 2}, 3)


@query("s9_p1_base_areas", "select poly as name, lpad((row_number() over (order by poly) + 1000)::varchar,5,'0') as code, .25e0 as area from {squares}")
def _(v):
    numbered = distributed_row_number(v.squares, [F.col("poly")], "n").withColumn("rings", G.square(F.col("x0"), F.col("y0"), 0.5))
    rows = numbered.select(F.floor("x0").alias("page"), "n", "poly", "rings", (F.col("n") + 1000).cast("string").alias("code_insee"), F.col("poly").alias("nom"), F.lit("01").alias("dep"), F.lit("84").alias("reg"))
    feature = O.feature_json(["code_insee", "nom", "dep", "reg"], "Polygon", O.rounded_rings(F.col("rings")))
    at = F.row_number().over(W.partitionBy("page").orderBy("n"))
    rows = rows.select("page", at.cast("bigint").alias("ord"), feature.alias("value"))
    rows = rows.withColumn("value", F.when(F.col("ord") > 1, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")))
    path = paged(rows, "features", ['{"type":"FeatureCollection","features":['], ["]}"])
    from zonalis.plans import area_pipelines as P

    areas = P.base_areas(R.read_features(v.spark, path, "code_insee:string,nom:string,dep:string,reg:string"))
    return areas.select("name", "code", F.round(G.polygon_area(F.col("rings")), 9).alias("area"))


@query("s8_s10_p38_piezometers", """
select 'B' || s_suppkey as code_bss, '2023-0' || (1 + s_suppkey % 9) || '-01' as date_fin_mesure, 2e0 as x, 45e0 + s_suppkey / 1e6 as y from {supplier} where s_suppkey % 3 > 0 and s_suppkey % 7 > 0
""")
def _(v):
    k = F.col("s_suppkey")
    last = F.when(k % 3 == 0, "2019-01-01").otherwise(F.concat(F.lit("2023-0"), (1 + k % 9).cast("string"), F.lit("-01")))
    both = v.supplier.withColumn("date_fin_mesure", F.explode(F.array(F.lit("2015-01-01"), last)))
    item = F.to_json(F.struct(F.concat(F.lit("B"), k.cast("string")).alias("code_bss"), "date_fin_mesure", F.when(k % 7 == 0, -60.0).otherwise(2.0).alias("x"), (45.0 + k / 1e6).alias("y")))
    page = page_of("s_suppkey", 300)
    at = F.row_number().over(W.partitionBy("page").orderBy("k", "date_fin_mesure"))
    rows = both.select(page.alias("page"), k.alias("k"), "date_fin_mesure", item.alias("value")).withColumn("ord", at.cast("bigint"))
    rows = rows.select("page", "ord", F.when(F.col("ord") > 1, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")).alias("value"))
    records = R.read_json_array(v.spark, paged(rows, "pages", ["["], ["]"]), "code_bss string, date_fin_mesure string, x double, y double")
    return Q.piezometers(records, "2022-01-01").select("code_bss", "date_fin_mesure", "x", "y")


@query("s11_archive_members", "select o_orderkey::varchar as id, o_orderstatus as status, o_orderpriority || ', \"x\"' as clerk from {orders}")
def _(v):
    """Archives of bounded size; every other one has its columns in another order."""
    from pyarrow import fs

    root = fresh_path(v.spark, "archives")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        page = int(rows["page"].iloc[0])
        columns = ["id", "clerk", "status"] if page % 2 else ["status", "id", "clerk"]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as box:
            box.writestr("readme.txt", "no data")
            box.writestr(f"data_{page}.csv", rows[columns].to_csv(index=False, escapechar="\\", doublequote=False))
        store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", f"{root}/a{page}.zip"))
        store.create_dir(inner.rsplit("/", 1)[0])
        with store.open_output_stream(inner) as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"page": [page]})

    rows = v.orders.select(F.floor(F.col("o_orderkey") / 2000).alias("page"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.concat("o_orderpriority", F.lit(', "x"')).alias("clerk"))
    rows.groupBy("page").applyInPandas(write, "page bigint").count()
    return R.split_member(R.read_archive_lines(v.spark, root + "/*.zip", r"^data_"), ["id", "status", "clerk"])


@query("s12_timetable_feed", """
select 'T' || o_orderkey as trip_id, o_orderpriority as route_id, count(*) as calls, max(l_quantity)::int as latest, min(s_name) as first_stop from {lineitem} join {orders} on l_orderkey=o_orderkey join {supplier} on l_suppkey=s_suppkey group by 1, 2
""")
def _(v):
    root = fresh_path(v.spark, "feed")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    tables = {
        "feed_info": v.region.select(F.col("r_name").alias("feed_publisher_name"), F.lit("20240101").alias("feed_start_date")),
        "calendar_dates": v.orders.select(F.col("o_orderpriority").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date")).distinct(),
        "trips": v.orders.select(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("trip_id"), F.col("o_orderpriority").alias("route_id")),
        "stops": v.supplier.select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name")),
        "stop_times": v.lineitem.select(F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("l_quantity").cast("int").alias("minute")),
    }
    for name, df in tables.items():
        text(df).write.csv(f"{root}/{name}.txt", header=True)
    t = R.read_timetable(v.spark, root)
    calls = t["stop_times"].join(t["stops"], "stop_id").join(t["trips"], "trip_id")
    return calls.groupBy("trip_id", "route_id").agg(F.count("*").alias("calls"), F.max(F.col("minute").cast("int")).alias("latest"), F.min("stop_name").alias("first_stop"))


@query("s15_stacked_blocks", "select row_number() over (order by code) - 1 as number, population::double as value, lon as x, lat as y from {areas} where population % 11 > 0 or true")
def _(v):
    rows = distributed_row_number(v.areas.select("code", "population", "lon", "lat"), [F.col("code")], "n")
    n = rows.count()
    values = rows.select((F.col("n") - 1).alias("number"), F.concat(F.lit(" "), F.col("population").cast("string")).alias("line"))
    places = rows.select((F.col("n") - 1 + n).alias("number"), F.concat_ws("; ", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("line"))
    return R.stacked_blocks(values.unionByName(places), n)


@query("s16_o1_processed_table", "select code, population, acctbal from {areas}")
def _(v):
    root = fresh_path(v.spark, "processed")
    O.write_area_table(v.areas.select("code", "population", "acctbal"), f"{root}/people")
    return processed(v.spark, root, "people", ("people", "fires"))


@query("o5_network_documents", """
with t as (select trip, product, list(stop order by pos) as s from {patterns} group by 1, 2), p as (select product, s, count(*) as runs from t group by 1, 2), n as (select stop, row_number() over (order by stop) - 1 as number from (select distinct stop from {patterns})),
x as (select product, s, runs, unnest(s) as stop, unnest(range(len(s))) as place from p)
select product, string_agg(n.number::varchar, ',' order by place) as stops, any_value(runs) as runs from x join n on x.stop = n.stop group by product, s
""")
def _(v):
    lines = cut(A.collapsed_sequences(v.patterns)).withColumn("flags", F.transform("stops", lambda s: F.lit(0)))
    names = v.patterns.select("stop").distinct().select("stop", F.lit(None).cast("string").alias("name"))
    areas = names.select("stop", F.lit("area").alias("name"), F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat"))
    documents = O.network_documents(lines)
    out = O.numbered_patterns(documents, O.network_stops(lines, areas, names))
    return out.select("product", F.array_join(F.transform("stops", lambda s: s.cast("string")), ",").alias("stops"), "runs")


@query("o2_s9_features_round_trip", "select poly, x0, y0 from {squares}")
def _(v):
    path = fresh_path(v.spark, "features")
    O.write_features(squares(v), ["poly"], path)
    rows = v.spark.read.schema("properties struct<poly:string>, geometry struct<type:string,coordinates:string>").json(path)
    b = G.bounds(F.col("rings"))
    return rows.select("properties.poly", R.polygon_rings(F.col("geometry.coordinates"), F.col("geometry.type")).alias("rings")).select("poly", b["min_x"].alias("x0"), b["min_y"].alias("y0"))
