"""Join and set queries (J, U)."""

from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators import joins as J
from zonalis.operators import spatial as S
from zonalis.plans.catalogue import query


def customer_code(key):
    """The five characters that the areas view makes of a customer key; keys of six digits share them."""
    return F.lpad(key.cast("string"), 5, "0")


def keyed_areas(v):
    """``(id, code, population)`` of the areas view with the customer key, which is unique, as ``id``."""
    k = F.col("c_custkey")
    return v.customer.select(k.alias("id"), customer_code(k).alias("code"), (1 + k * 7907 % 50_000).alias("population"))


def squares(v):
    return v.squares.select("poly", G.square(F.col("x0"), F.col("y0"), 0.5).alias("rings"))


@query("j1_wide_join", """
select a.code, a.dep, a.population, s.n_orders, round_even(s.spend, 4) as spend, coalesce(f.n_fires, null) as n_fires, round_even(f.ha, 4) as ha from {areas} a
left join {area_stats} s on a.code = s.code left join (select code, count(*) as n_fires, sum(ha) as ha from {fires} group by 1) f on a.code = f.code
""")
def _(v):
    fires = v.fires.groupBy("code").agg(F.count("*").alias("n_fires"), F.sum("ha").alias("ha"))
    return J.wide_join(v.areas.select("code", "dep", "population"), [v.area_stats.select("code", "n_orders", "spend"), fires], numeric={"spend": "double", "ha": "double"})


@query("j2_join_diagnostics", """
with t as (select lpad((c_custkey*2)::varchar,5,'0') as code from {customer}), m as (select t.code, a.code as hit from t left join {areas} a on t.code = a.code)
select count(*) as rows, count(hit) as matched, count(*) - count(hit) as unmatched, count(hit)/count(*)::double as rate, count(distinct hit)/(select count(*) from {areas})::double as coverage,
 array_to_string(list_slice(list_sort(list(distinct code) filter (where hit is null)),1,10),',') as sample from m
""")
def _(v):
    table = v.customer.select(F.lpad((F.col("c_custkey") * 2).cast("string"), 5, "0").alias("code"))
    return J.join_diagnostics(table, v.areas).withColumn("sample", F.when(F.col("unmatched") > 0, F.array_join("sample", ",")))


@query("j3_j5_lookup_and_gap_fill", """
select a.code, n_name, coalesce(k.n,0) as n, case when coalesce(k.n,0)=0 then 'aucun' else 'present' end as class from {areas} a left join {nation} on a.dep = lpad(n_nationkey::varchar,2,'0')
left join (select code, count(*) as n from {fires} where ha > 8 group by 1) k on a.code=k.code
""")
def _(v):
    facts = v.fires.where("ha > 8").groupBy("code").agg(F.count("*").alias("n"))
    names = v.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("dep"), "n_name")
    out = J.filled_join(v.areas.join(names, "dep", "left"), facts, {"n": 0})
    return out.select("code", "n_name", "n", F.when(F.col("n") == 0, "aucun").otherwise("present").alias("class"))


@query("j4_full_outer", """
select coalesce(a.code,b.code) as code, a.n as fires, b.n as sales from (select code, count(*) as n from {fires} where year = 1995 group by 1) a
full outer join (select code, count(*) as n from {sale_rows} where annee = 1996 group by 1) b on a.code=b.code
""")
def _(v):
    a = v.fires.where("year = 1995").groupBy("code").agg(F.count("*").alias("fires"))
    b = v.sale_rows.where("annee = 1996").groupBy("code").agg(F.count("*").alias("sales"))
    return a.join(b, "code", "full_outer")


@query("j6_j7_reindex_and_remap", """
select case when c_custkey % 50 = 0 then lpad((c_custkey-1)::varchar,5,'0') else lpad(c_custkey::varchar,5,'0') end as code, count(*) as n from (
 select c_custkey from {customer} where c_custkey > 0) group by 1
""")
def _(v):
    key = F.col("c_custkey")
    moves = v.customer.where(key % 50 == 0).select(key.alias("old"), (key - 1).alias("new"))
    moved = J.remapped(v.customer.where(key > 0).select(key), v.customer.where(key % 50 != 0), moves, "c_custkey")
    kept = moved.groupBy(customer_code(key).alias("code")).agg(F.count("*").alias("n"))
    return J.reindexed(kept, kept.select("code"))


@query("j8_department_to_area", """
select a.code, d.people, d.areas from {areas} a join (select dep, sum(population)::bigint as people, count(*) as areas from {areas} group by 1) d on a.dep = d.dep
""")
def _(v):
    groups = v.areas.groupBy("dep").agg(F.sum("population").alias("people"), F.count("*").alias("areas"))
    return J.downward(v.areas.select("code", "dep"), groups, F.col("dep"), "dep").select("code", "people", "areas")


@query("j9_point_in_polygon", """
select a.code, s.poly from {areas} a left join {squares} s on cast(floor(a.lon*2) as int)/2e0 = s.x0 and cast(floor(a.lat*2) as int)/2e0 = s.y0
""")
def _(v):
    points = v.areas.select("code", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return S.one_polygon(S.points_in_polygons(points, squares(v), 0.5), ["code", "x", "y"]).select("code", "poly")


@query("j10_lines_meeting_polygons", """
select distinct code from (select code, lon, lat, unnest([0.0,0.3]) as d from {areas}) l join {squares} s on floor((lon + d)*2)/2e0 = s.x0 and floor(lat*2)/2e0 = s.y0
""")
def _(v):
    line = F.array(G.point(F.col("lon"), F.col("lat")), G.point(F.col("lon") + 0.3, F.col("lat")))
    lines = v.areas.select(F.col("code").alias("line_id"), line.alias("line"))
    return S.lines_meeting_polygons(lines, squares(v), 0.5).select(F.col("line_id").alias("code")).distinct()


@query("j11_nearest", """
select code, venue_id as site, round(distance, 9) as distance from (select code, venue_id, sqrt(dx*dx+dy*dy) as distance, row_number() over (partition by code order by sqrt(dx*dx+dy*dy), venue_id) as r from (
 select a.code, v.venue_id, v.lon-a.lon as dx, v.lat-a.lat as dy from {areas} a, {venues} v)) where r = 1
""")
def _(v):
    points = v.areas.select(F.col("code").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    sites = v.venues.select(F.col("venue_id").alias("site"), F.col("lon").alias("sx"), F.col("lat").alias("sy"))
    best = S.nearest(points, sites, 0.5).groupBy("id").agg(F.min(F.struct("distance", "site")).alias("best"))
    return best.select(F.col("id").alias("code"), "best.site", F.round("best.distance", 9).alias("distance"))


@query("j12_within_distance", """
select a.code, count(*) as n, round(sum(sqrt((v.lon-a.lon)**2+(v.lat-a.lat)**2)),6) as total from {areas} a join {venues} v on sqrt((v.lon-a.lon)**2+(v.lat-a.lat)**2) <= 1.0 group by 1
""")
def _(v):
    left = v.areas.select("code", F.col("lon").alias("x"), F.col("lat").alias("y"))
    right = v.venues.select(F.col("lon").alias("rx"), F.col("lat").alias("ry"), F.lit(1).alias("one"))
    at = S.sums_within(left, right, 1.0, {"n": ("one", lambda d: F.lit(1)), "total": ("one", lambda d: d)})
    return left.join(at, ["x", "y"]).groupBy("code").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))


@query("j13_j14_cell_sample", """
with cells as (select floor((lat-41)/0.5)::bigint as r, floor((lon+6)/0.5)::bigint as c, max(population) as value from {areas} where population % 2 = 0 group by 1,2)
select a.code, cells.value from {areas} a left join cells on floor((lat-41)/0.5) = r and floor((lon+6)/0.5) = c
""")
def _(v):
    row, col = F.floor((F.col("lat") - 41) / 0.5), F.floor((F.col("lon") + 6) / 0.5)
    cells = v.areas.where("population % 2 = 0").groupBy(row.alias("row"), col.alias("col")).agg(F.max("population").alias("value"))
    points = v.areas.select("code", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return J.sample_cells(points, cells, -6.0, 41.0, 0.5, 0.5).select("code", "value")


@query("j15_j16_snap_and_fallback", """
with s as (select round_even(lon,0)+0e0 as gx, round_even(lat,0)+0e0 as gy, avg(poids) as poids from {venues} group by 1,2), d as (select avg(poids) as poids from {venues})
select a.code, round(coalesce(s.poids, case when a.population > 25000 then 0.5 end, d.poids),9) as value, case when s.poids is not null then 'grid' when a.population > 25000 then 'area' else 'mean' end as method
from {areas} a left join s on round_even(a.lon,0)=s.gx and round_even(a.lat,0)=s.gy, d
""")
def _(v):
    mean = v.venues.agg(F.avg("poids").alias("mean"))
    rows = J.lattice_join(v.areas, v.venues, "poids").crossJoin(F.broadcast(mean))
    value, method = J.fallback({"grid": F.col("grid"), "area": F.when(F.col("population") > 25000, F.lit(0.5)), "mean": F.col("mean")})
    return rows.select("code", F.round(value, 9).alias("value"), method.alias("method"))


@query("j17_j18_year_joins", """
with a as (select point, year, sum(precip) as p from {daily_grid} group by 1,2), b as (select l_suppkey as point, year(l_shipdate)::int as year, count(*) as n from {lineitem} group by 1,2)
select a.point, a.year, round(p,6) as p, n, abs(p - n) > 50 as off from a join b on a.point=b.point and a.year=b.year
""")
def _(v):
    a = v.daily_grid.groupBy("point", "year").agg(F.sum("precip").alias("p"))
    b = v.lineitem.groupBy(F.col("l_suppkey").alias("point"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    bad = J.disagreements(a, b, ["point", "year"], "p", "n", 50.0).select("point", "year", F.lit(True).alias("bad"))
    joined = a.join(b, ["point", "year"]).join(bad, ["point", "year"], "left")
    return joined.select("point", "year", F.round("p", 6).alias("p"), "n", F.coalesce("bad", F.lit(False)).alias("off"))


@query("k26_range_lookup_join", """
select b.band, count(*) as n, sum(population)::bigint as people from {areas} a join (values ('small',0,9999),('mid',10000,29999),('big',30000,99999)) b(band,lo,hi) on a.population between b.lo and b.hi group by 1
""")
def _(v):
    bands = v.spark.createDataFrame([("small", 0, 9999), ("mid", 10000, 29999), ("big", 30000, 99999)], "band string, lo int, hi int")
    joined = v.areas.join(F.broadcast(bands), F.col("population").between(F.col("lo"), F.col("hi")))
    return joined.groupBy("band").agg(F.count("*").alias("n"), F.sum("population").alias("people"))


@query("u1_u2_unions", """
select src, count(*) as n, count(distinct code) as codes from (select 'fires' as src, code from {fires} union all select 'sales', code from {sale_rows} union all select 'areas', code from {areas}) group by 1
union all select 'all', count(*), count(*) from (select code from {fires} union select code from {sale_rows} union select code from {areas})
""")
def _(v):
    every = J.stacked({"fires": v.fires, "sales": v.sale_rows, "areas": v.areas}, ["code"])
    keys = every.select("code").distinct().agg(F.lit("all").alias("src"), F.count("*").alias("n"), F.count("*").alias("codes"))
    return every.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes")).unionByName(keys)


@query("u3_u5_key_sets", """
with f as (select distinct code from {fires} where year = 1995), s as (select distinct code from {sale_rows} where annee = 1997)
select code, 'both' as kind from (select code from f intersect select code from s) union all select code, 'fires' from (select code from f except select code from s)
union all select code, 'neither' from {areas} where code not in (select code from f) and code not in (select code from s)
""")
def _(v):
    f, s = v.fires.where("year = 1995").select("code"), v.sale_rows.where("annee = 1997").select("code")
    return J.key_sets(f, s, v.areas, ("both", "fires", "neither"))


@query("u4_top_overlap", """
select count(*) as shared from (select code from (select code from {area_stats} where spend is not null order by spend desc, code limit 100) intersect select code from (select code from {area_stats} where avg_price is not null order by avg_price desc, code limit 100))
""")
def _(v):
    return J.top_overlap(v.area_stats, "spend", "avg_price", 100)
