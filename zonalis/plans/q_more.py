"""Queries of operators that the other modules use only inside others (K31, K32, F3, F7, F11, D4, X2-X4, Q9, Q10, J14,
R2, R3, W14, Q8) and of composed rules."""

from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators import aggregates as A
from zonalis.operators import contract as Q
from zonalis.operators import joins as J
from zonalis.operators import network as N
from zonalis.operators import scoring as S
from zonalis.operators import spatial as SP
from zonalis.operators import stats as T
from zonalis.plans.catalogue import query
from zonalis.plans.q_joins import squares


@query("k31_math", """
select code, round(ln(1+population),9) as log1p, round(log10(population),9) as log10, round(exp(lon/10),9) as exp, round(0.5e0**(population/10000e0),9) as half, round(sqrt(population),9) as root, round(sqrt(lon*lon+lat*lat),9) as hypot,
 round(cos(radians(lat)),9) as cos, floor(lon)::bigint as floor, round_even(lat,0) as rint, least(greatest(acctbal,0),5000) as clip from {areas}
""")
def _(v):
    p, lon, lat = F.col("population"), F.col("lon"), F.col("lat")
    values = {
        "log1p": F.log1p(p), "log10": F.log10(p), "exp": F.exp(lon / 10), "half": F.pow(F.lit(0.5), p / 10_000.0), "root": F.sqrt(p.cast("double")), "hypot": F.hypot(lon, lat), "cos": F.cos(F.radians(lat)),
    }
    return v.areas.select("code", *[F.round(c, 9).alias(n) for n, c in values.items()], F.floor(lon).alias("floor"), F.rint(lat).alias("rint"), F.least(F.greatest("acctbal", F.lit(0.0)), F.lit(5000.0)).alias("clip"))


@query("k32_arrays", """
with l as (select o_custkey as code, list(o_totalprice order by o_orderkey) as a from {orders} group by 1)
select code, len(a)::int as n, list_filter(a, lambda x: x > 100000)[1] as first_large, list_max(a) as largest, round(list_sum(a[1:2]),2) as first_two, list_position(a, list_max(a))::bigint as place from l
""")
def _(v):
    lists = v.orders.groupBy(F.col("o_custkey").alias("code")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("r"))
    text = lists.select("code", F.to_json(F.transform("r", lambda x: x["o_totalprice"])).alias("j"))
    a = text.select("code", F.from_json("j", "array<double>").alias("a"))
    return a.select(
        "code", F.size("a").alias("n"), F.get(F.filter("a", lambda x: x > 100_000), F.lit(0)).alias("first_large"), F.array_max("a").alias("largest"),
        F.round(F.aggregate(F.slice("a", 1, 2), F.lit(0.0), lambda s, x: s + x), 2).alias("first_two"), F.array_position("a", F.array_max("a")).alias("place"))


@query("f3_boxes", "select poly from {squares} where x0 <= 2e0 and x0 + 0.5e0 >= 0e0 and y0 <= 47e0 and y0 + 0.5e0 >= 44e0")
def _(v):
    return squares(v).where(G.boxes_overlap(G.bounds(F.col("rings")), 0.0, 44.0, 2.0, 47.0)).select("poly")


@query("f7_usable_sales", """
with m as (select id_mutation, max(valeur) as value, count(distinct code) as nc, count(distinct type_local) as nt, min(code) as code, min(type_local) as kind, sum(surface) as surface from {sale_rows} group by 1)
select code, kind, round(value,2) as value, round(value/surface,6) as per_m2 from m where value > 0 and nc = 1 and nt = 1 and surface >= 9 and kind in ('A','N') and value/surface between 200 and 20000
""")
def _(v):
    out = A.sales(v.sale_rows, ["A", "N"], 9.0, (200.0, 20_000.0))
    return out.select("code", "kind", F.round("value", 2).alias("value"), F.round("per_m2", 6).alias("per_m2"))


@query("f11_column_order", "select code, population as people, acctbal as balance from {areas}")
def _(v):
    return v.areas.withColumnsRenamed({"population": "people", "acctbal": "balance"}).select("code", "people", "balance")


@query("d4_one_polygon", """
with c as (select poly as corner, x0 as x, y0 as y from {squares}) select corner, min(poly) as poly from (select c.corner, s.poly from c join {squares} s on abs(c.x + 0.25 - s.x0 - 0.25) < 0.3 and abs(c.y + 0.25 - s.y0 - 0.25) < 0.3) group by 1
""")
def _(v):
    """Points inside overlapping areas: every square is stretched over its neighbour."""
    points = v.squares.select(F.col("poly").alias("corner"), (F.col("x0") + 0.25).alias("x"), (F.col("y0") + 0.25).alias("y"))
    wide = v.squares.select("poly", G.square(F.col("x0") - 0.05, F.col("y0") - 0.05, 0.6).alias("rings"))
    return SP.one_polygon(SP.points_in_polygons(points, wide, 0.5), ["corner"])


CRITERIA = [{"column": "population", "dir": "up", "weight": 2.0, "bad": 0.0, "ideal": 40_000.0}, {"column": "acctbal", "dir": "down", "weight": 1.0, "bad": 9000.0, "ideal": -500.0}]


@query("x2_declared_criteria", """
with d as (select code, least(greatest(population/40000e0,0),1) as a, least(greatest((acctbal-9000)/(-9500e0),0),1) as b from {area_stats}) select code, round(case when a <= 0 or b <= 0 then 0 else exp((2*ln(a)+ln(b))/3) end,9) as score from d
""")
def _(v):
    criteria = [S.Criterion(**c) for c in CRITERIA]
    return S.with_desirabilities(v.area_stats, criteria).select("code", F.round(S.combined(criteria), 9).alias("score"))


@query("x3_combined_columns", """
with b as (select code, spend as x, acctbal as y from {area_stats} where spend is not null), s as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from b) select code, round(greatest((x-mx)/sx, (y-my)/sy),6) as higher from b, s
""")
def _(v):
    return T.standardised(v.area_stats, "spend", "acctbal", lambda a, b: F.greatest(a, b), "higher").select("code", F.round("higher", 6).alias("higher"))


@query("x4_aggregates_with_state", """
select dep, round(sum(avg_price*population)/sum(case when avg_price is not null then population end),4) as mean, round(sum(population*population)/1e6,4) as pp, round(sum(population*acctbal)/1e6,4) as pa from {area_stats} group by 1
""")
def _(v):
    p = F.col("population").cast("double")
    return v.area_stats.groupBy("dep").agg(F.round(A.weighted_mean(F.col("avg_price"), p), 4).alias("mean"), F.round(F.sum(p * p) / 1e6, 4).alias("pp"), F.round(F.sum(p * F.col("acctbal")) / 1e6, 4).alias("pa"))


@query("q9_q10_gates_and_names", "select 'c_nationkey' as name union all select 'c_mktsegment'")
def _(v):
    """The gate lets a table without key faults pass; then the names that a shapefile would cut.

    Order sums have one row a code, which areas needn't have."""
    Q.gate(Q.key_faults(v.order_sums.select("code")).where("check = 'duplicate_key'"), "order_sums")
    names = [c for c in Q.long_names(v.customer.columns) if c != "c_comment"]
    return v.spark.createDataFrame([(n,) for n in names], "name string")


@query("q8_layer_keys", """
select unnest(case n_nationkey % 4 when 0 then ['no_label'] when 1 then ['no_group', 'bad_kind'] when 2 then ['bare_rank'] else [] end) as "check", n_name as detail from {nation}
""")
def _(v):
    k = F.col("n_nationkey")
    none = F.lit(None)
    layers = v.nation.select(
        F.col("n_name").alias("layer"), F.lit("numeric").alias("type"), none.cast("array<double>").alias("breaks"), none.cast("array<string>").alias("colors"), none.cast("array<double>").alias("stops"),
        F.when(k % 4 > 0, "Label").alias("label"), F.when(k % 4 != 1, "group").alias("group"), F.when(k % 4 == 1, "raster").otherwise("point").alias("kind"), (k % 2 == 0).alias("ranked"),
        F.when(k % 4 == 0, 0.5).alias("band"), none.cast("string").alias("note"))
    return Q.layer_faults(layers).select("check", "detail")


@query("j14_terrain_tiles", """
with t as (select distinct floor(lat)::int as la, floor(lon)::int as lo from {areas} where floor(lat)::int % 3 > 0), p as (select code, floor(lat)::int as la, floor(lon)::int as lo, least(greatest(floor((floor(lat)+1-lat)*10),0),9)::int as r, least(greatest(floor((lon-floor(lon))*10),0),9)::int as c from {areas})
select code, case when t.la is not null then r*10+c+abs(p.la)*100e0 end as height from p left join t on p.la=t.la and p.lo=t.lo
""")
def _(v):
    from zonalis.functions import keys as K

    pixels = F.sequence(F.lit(0), F.lit(9))
    tiles = v.areas.where(F.floor("lat") % 3 > 0).select(K.tile_key(F.col("lon"), F.col("lat")).alias("tile"), F.floor("lat").alias("la")).distinct()
    tiles = tiles.withColumn("row", F.explode(pixels)).withColumn("col", F.explode(pixels)).select("tile", "row", "col", (F.col("row") * 10 + F.col("col") + F.abs("la") * 100.0).alias("value"))
    return J.sample_tiles(v.areas.select("code", "lon", "lat"), tiles, 10).select("code", F.col("value").alias("height"))


@query("w14_fitted_line", """
with b as (select population::double as x, acctbal as y from {areas}), f as (select regr_slope(y,x) as m, regr_intercept(y,x) as k, quantile_cont(x,0.01) as x0, quantile_cont(x,0.99) as x1, quantile_cont(y,0.01) as y0, quantile_cont(y,0.99) as y1 from b),
t as (select *, k+m*x0 as ya, m*(x1-x0) as dy from f), e as (select *, greatest(0,least((y0-ya)/dy,(y1-ya)/dy)) as t0, least(1,greatest((y0-ya)/dy,(y1-ya)/dy)) as t1 from t)
select round(m,9) as slope, round(k,5) as intercept, round(x0+t0*(x1-x0),4) as x1, round(ya+t0*dy,4) as y1, round(x0+t1*(x1-x0),4) as x2, round(ya+t1*dy,4) as y2 from e
""")
def _(v):
    out = T.fitted_line(v.areas.select(F.col("population").cast("double").alias("x"), F.col("acctbal").alias("y")), "x", "y")
    return out.select(F.round("slope", 9).alias("slope"), F.round("intercept", 5).alias("intercept"), *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("r2_station_lines", """
with l as (select poly as lid, x0, y0, x0+0.5e0 as x1 from {squares}), d as (select a.code as pid, l.lid, sqrt((a.lon-(x0+least(greatest(a.lon-x0,0),0.5)))**2+(a.lat-y0)**2) as away, l.lid like 'P1%' as lgv from {areas} a join l on abs(a.lat-y0) <= 0.3 and a.lon >= x0-0.3 and a.lon <= x1+0.3),
n as (select * from d where away <= 0.3), h as (select pid, min(away) as best, arg_min(lid, struct_pack(w := away, l := lid)) as home from n group by 1)
select n.pid, n.lid, n.lid = h.home as home from n join h on n.pid=h.pid where n.lid = h.home or (n.away <= h.best+0.15 and not n.lgv)
""")
def _(v):
    points = v.areas.select(F.col("code").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    lines = v.squares.select(F.col("poly").alias("lid"), "x0", "y0", (F.col("x0") + 0.5).alias("x1"), F.col("y0").alias("y1"), F.col("poly").startswith("P1").alias("lgv"))
    return N.station_lines(points, lines, 0.3, 0.15).select("pid", "lid", "home")


@query("r3_united_cuts", """
with c as (select l_suppkey as lid, s, 'n' || l_suppkey || ':' || dense_rank() over (partition by l_suppkey order by s) as node from (select distinct l_suppkey, l_quantity + 0.3e0*(l_linenumber % 2) as s from {lineitem})),
g as (select *, sum(new) over (partition by lid order by s) as grp from (select *, case when s - lag(s) over (partition by lid order by s) < 0.5 then 0 else 1 end as new from c)),
u as (select *, min(node) over (partition by lid, grp) as name, lead(s) over (partition by lid order by s) as t, lead(grp) over (partition by lid order by s) as h from g),
n as (select distinct lid, grp, name from u)
select u.lid, u.name as src, n.name as dst, round(t-s,9) as length from u join n on u.lid=n.lid and u.h=n.grp where t - s >= 0.5
""")
def _(v):
    from pyspark.sql import Window as W

    cuts = v.lineitem.select(F.col("l_suppkey").alias("lid"), (F.col("l_quantity") + 0.3 * (F.col("l_linenumber") % 2)).alias("s")).distinct()
    place = F.dense_rank().over(W.partitionBy("lid").orderBy("s"))
    cuts = cuts.withColumn("node", F.concat(F.lit("n"), F.col("lid").cast("string"), F.lit(":"), place.cast("string")))
    speeds = v.supplier.select(F.col("s_suppkey").alias("lid"), F.lit(100.0).alias("kmh"), F.lit(False).alias("lgv"))
    return N.cut_edges(cuts, speeds).select("lid", "src", "dst", F.round("length", 9).alias("length"))
