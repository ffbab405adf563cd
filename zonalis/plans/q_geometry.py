"""Geometry queries (G)."""

from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions import projections as P
from zonalis.operators import spatial as S
from zonalis.plans.catalogue import query
from zonalis.plans.q_joins import squares


@query("g1_g2_g3_measures", "select poly, 0.25e0 as area, 2e0 as outline, x0 as min_x, y0 as min_y, x0+0.5e0 as max_x, y0+0.5e0 as max_y, x0 <= 2e0 and x0+0.5e0 >= 0e0 and y0 <= 47e0 and y0+0.5e0 >= 44e0 as inside from {squares}")
def _(v):
    r = F.col("rings")
    b = G.bounds(r)
    return squares(v).select("poly", F.round(G.polygon_area(r), 9).alias("area"), F.round(G.line_length(r[0]), 9).alias("outline"), *[c.alias(n) for n, c in b.items()], G.boxes_overlap(b, 0.0, 44.0, 2.0, 47.0).alias("inside"))


@query("g4_g5_g6_centres", "select poly, round(x0+0.25e0,4) as cx, round(y0+0.25e0,4) as cy, round(x0+0.25e0,6) as ix, true as inside, false as outside from {squares}")
def _(v):
    r = F.col("rings")
    rows = squares(v).withColumns({"c": G.largest_ring_centroid(r), "i": G.interior_point(r)})
    return rows.select("poly", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.round("i.x", 6).alias("ix"), G.in_polygon(F.col("i.x"), F.col("i.y"), r).alias("inside"), G.in_polygon(F.col("i.x") + 1, F.col("i.y"), r).alias("outside"))


@query("g8_g9_lattices", "select poly, count(*) as n, round(avg(x0+0.5e0*(i+0.5)/4),6) as mean_x, round(avg(y0+0.5e0*(j+0.5)/4),6) as mean_y from {squares}, (select unnest(range(4)) as i), (select unnest(range(4)) as j) group by 1")
def _(v):
    offsets = F.array(*map(F.lit, G.sample_offsets(4, 0.5)))
    b = G.bounds(F.col("rings"))
    rows = squares(v).withColumns({"x0": b["min_x"], "y0": b["min_y"]}).withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
    return rows.groupBy("poly").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x0") + F.col("dx")), 6).alias("mean_x"), F.round(F.avg(F.col("y0") + F.col("dy")), 6).alias("mean_y"))


@query("g10_distances", "select code, round(sqrt(((2.35-lon)*111.320*cos(radians(lat)))**2+((48.85-lat)*110.574)**2),6) as km, round(sqrt((lon-2.35)**2+(lat-48.85)**2),9) as flat from {areas}")
def _(v):
    lon, lat = F.col("lon"), F.col("lat")
    return v.areas.select("code", F.round(G.flat_km(lon, lat, F.lit(2.35), F.lit(48.85)), 6).alias("km"), F.round(F.hypot(lon - 2.35, lat - 48.85), 9).alias("flat"))


@query("g11_shape_faults", "select poly, case when i % 4 = 0 then 'open_ring' when i % 4 = 1 then 'short_ring,open_ring' when i % 4 = 2 then 'range' else '' end as faults from (select poly, ascii(substr(poly, 2)) + length(poly) as i from {squares})")
def _(v):
    i = F.ascii(F.substring("poly", 2, 5)) + F.length("poly")
    ring = F.col("rings")[0]
    far = F.transform(ring, lambda p: F.struct((p["x"] + 500).alias("x"), p["y"].alias("y")))
    made = F.when(i % 4 == 0, F.slice(ring, 1, 4)).when(i % 4 == 1, F.slice(ring, 1, 3)).when(i % 4 == 2, far).otherwise(ring)
    return squares(v).select("poly", F.array_join(G.shape_faults(F.array(made)), ",").alias("faults"))


@query("g12_mosaic_outline", """
with e as (select poly, unnest([[x0,y0,x0+0.5,y0],[x0,y0+0.5,x0+0.5,y0+0.5],[x0,y0,x0,y0+0.5],[x0+0.5,y0,x0+0.5,y0+0.5]]) as e from {squares})
select count(*) as edges, count(*) filter (where n = 1) as outline from (select e, count(*) as n from e group by 1)
""")
def _(v):
    edges = S.mosaic_edges(squares(v))
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("outline"))


@query("g13_city_labels", "select s.poly, any_value(s.x0)+0.25e0 as x, sum(population)::bigint as population from {squares} s join {areas} a on floor(a.lon*2)/2e0=s.x0 and floor(a.lat*2)/2e0=s.y0 group by 1 having sum(population) >= 100000 order by population desc")
def _(v):
    cell = lambda c: F.floor(F.col(c) * 2) / 2.0
    people = v.areas.groupBy(cell("lon").alias("x0"), cell("lat").alias("y0")).agg(F.sum("population").alias("population")).where("population >= 100000")
    b = G.bounds(F.col("rings"))
    rows = squares(v).withColumns({"x0": b["min_x"], "y0": b["min_y"]}).join(people, ["x0", "y0"]).withColumnRenamed("poly", "name")
    return S.city_labels(rows, 100_000).select(F.col("name").alias("poly"), F.round("x", 6).alias("x"), "population")


@query("g7_projection_round_trips", "select code, round(lon,6) as lon93, round(lat,6) as lat93, round(lon,6) as lon35, round(lat,6) as lat35, round(radians(lon)*6378137,3) as mx, round(ln(tan(pi()/4+radians(lat)/2))*6378137,3) as my from {areas}")
def _(v):
    lon, lat = F.col("lon"), F.col("lat")
    x, y = P.lambert93(lon, lat)
    u, w = P.laea(lon, lat)
    rows = v.areas.withColumns({"x": x, "y": y, "u": u, "w": w})
    a, b = P.from_lambert93(F.col("x"), F.col("y"))
    c, d = P.from_laea(F.col("u"), F.col("w"))
    mx, my = P.mercator(lon, lat)
    return rows.select("code", F.round(a, 6).alias("lon93"), F.round(b, 6).alias("lat93"), F.round(c, 6).alias("lon35"), F.round(d, 6).alias("lat35"), F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))


@query("g14_thinned_lines")
def _(v):
    from zonalis.operators.thinning import thinned

    points = v.lineitem.select(F.col("l_suppkey").alias("line"), F.col("l_orderkey").cast("double").alias("x"), F.col("l_quantity").alias("y"), F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").alias("pos"))
    return thinned(points, 5.0).groupBy("line").agg(F.count("*").alias("n"))
