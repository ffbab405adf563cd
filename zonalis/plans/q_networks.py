"""Graph and sequence queries (R)."""

from pyspark.sql import functions as F

from zonalis.operators import network as N
from zonalis.operators.ranking import distributed_row_number
from zonalis.plans.catalogue import query


def lattice(v):
    """Edges between neighbouring squares of the mosaic, a fifth of them fast."""
    s = v.squares.select(F.col("poly").alias("src"), F.col("x0"), F.col("y0"))
    right = s.select((F.col("x0") - 0.5).alias("x0"), "y0", F.col("src").alias("dst"))
    up = s.select("x0", (F.col("y0") - 0.5).alias("y0"), F.col("src").alias("dst"))
    both = s.join(right.unionByName(up), ["x0", "y0"])
    piece = F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 40))
    return both.select("src", "dst", piece.alias("piece"), (10.0 + F.pmod(piece, F.lit(50))).alias("seconds"), (piece % 5 == 0).alias("lgv"), F.lit(50_000.0).alias("length"))


@query("r1_components", """
with recursive e as (select a.poly as p, b.poly as q from {squares} a join {squares} b on (abs(a.x0-b.x0)=0.5 and a.y0=b.y0) or (abs(a.y0-b.y0)=0.5 and a.x0=b.x0)),
r(node, top) as (select poly, poly from {squares} union select e.q, r.top from r join e on e.p=r.node) select node, min(top) as component from r where node in (select p from e) group by 1
""")
def _(v):
    return N.merged_nodes(lattice(v).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("r2_snapped_stops", """
with l as (select poly as lid, x0, y0, x0+0.5e0 as x1, y0 as y1 from {squares}), d as (select a.code as pid, l.lid, sqrt((a.lon-(x0+least(greatest(a.lon-x0,0),0.5)))**2+(a.lat-y0)**2) as away, least(greatest(a.lon-x0,0),0.5) as along from {areas} a join l on abs(a.lat-y0) <= 0.2 and a.lon >= x0-0.2 and a.lon <= x1+0.2)
select pid, lid, round(away,9) as away, round(along,9) as along from (select *, row_number() over (partition by pid order by round(away,12), lid) as r from d where away <= 0.2) where r = 1
""")
def _(v):
    points = v.areas.select(F.col("code").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    lines = v.squares.select(F.col("poly").alias("lid"), "x0", "y0", (F.col("x0") + 0.5).alias("x1"), F.col("y0").alias("y1"))
    return N.snapped_points(points, lines, 0.2).select("pid", "lid", F.round("away", 9).alias("away"), F.round("along", 9).alias("along"))


@query("r3_cut_edges", """
with c as (select distinct l_suppkey as lid, l_quantity as s from {lineitem}), e as (select lid, s, lead(s) over (partition by lid order by s) as t from c)
select lid, s::int as src, t::int as dst, t-s as length, round((t-s)/((case when lid % 2 = 0 then 160e0 else 80e0 end)/3.6),9) as seconds from e where t is not null
""")
def _(v):
    cuts = v.lineitem.select(F.col("l_suppkey").alias("lid"), F.col("l_quantity").alias("s"), F.col("l_quantity").cast("int").alias("node")).distinct()
    speeds = v.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("lid"), F.lit(160.0).alias("kmh"), F.lit(False).alias("lgv"))
    return N.cut_edges(cuts, speeds).select("lid", "src", "dst", "length", F.round("seconds", 9).alias("seconds"))


@query("r4_r5_r6_routed_hops")
def _(v):
    # The stops stand on the squares in the order of their codes.
    squares = distributed_row_number(v.squares.select("poly", "x0", "y0"), [F.col("poly")], "number")
    stops = squares.select((F.col("number") - 1).alias("stop"), F.col("poly").alias("node"), (F.col("x0") * 100_000.0).alias("x"), (F.col("y0") * 100_000.0).alias("y"))
    return N.routed_hops(lattice(v), v.patterns, stops, "1-URGENT", "5-LOW")


@query("r7_direct_reach", """
with l as (select *, max(pos) over (partition by trip) as last from {patterns}), b as (select trip, pos, minutes from l where stop = 7 and pos < last and product <> '5-LOW')
select l.stop, count(*) as runs, min(l.minutes - b.minutes) as fastest, array_to_string(list_sort(list(distinct l.product)),',') as products from b join l on b.trip=l.trip and l.pos > b.pos where l.stop <> 7 group by 1
""")
def _(v):
    later = N.rides(v.patterns, 7, "5-LOW")
    return N.destinations(later, 7).withColumn("products", F.array_join("products", ","))


@query("r7_r9_hop_and_spur_loads", """
with l as (select *, max(pos) over (partition by trip) as last, lag(stop) over (partition by trip order by pos) as prev from {patterns}), b as (select trip, pos from l where stop = 7 and pos < last),
h as (select l.product, least(prev,l.stop) as a, greatest(prev,l.stop) as b, count(*) as runs from b join l on b.trip=l.trip and l.pos > b.pos group by 1,2,3)
select product, stop, max(runs) as runs from (select product, a as stop, runs from h union all select product, b, runs from h) group by 1,2
""")
def _(v):
    return N.spur_loads(N.hop_runs(N.rides(v.patterns, 7)))


@query("r8_call_orders", """
with recursive l as (select *, max(pos) over (partition by trip) as last, arg_max(stop, pos) over (partition by trip) as terminus from {patterns}),
k as (select b.terminus, b.trip, b.pos as from_pos, l.pos, l.stop, l.minutes - b.minutes as since from l b join l on l.trip = b.trip and l.pos > b.pos where b.stop = 7 and b.pos < b.last and b.terminus <> 7),
h as (select *, lag(stop) over (partition by trip, from_pos order by pos) as prev from k where stop <> 7),
s as (select terminus, stop, count(*) as runs, min(since)::bigint as fastest from h group by 1, 2), t as (select terminus, count(distinct (trip, from_pos)) as line_runs from k group by 1),
q as (select terminus, stop, list(distinct prev) as prevs from h where prev is not null group by 1, 2),
w as (select distinct terminus, 0 as step, []::int[] as picked, null::int as stop from s union all
  select terminus, step + 1, list_append(picked, stop), stop from (select w.terminus, w.step, w.picked, s.stop,
    row_number() over (partition by w.terminus order by len(list_filter(coalesce(q.prevs, []), lambda x: not list_contains(w.picked, x))) > 0, s.fastest, s.stop) as o
    from w join s on s.terminus = w.terminus and not list_contains(w.picked, s.stop) left join q on q.terminus = s.terminus and q.stop = s.stop) where o = 1)
select w.terminus, (w.step - 1)::bigint as place, w.stop, s.runs, s.fastest, s.runs = t.line_runs as every_run from w join s on s.terminus = w.terminus and s.stop = w.stop join t on t.terminus = w.terminus where w.step > 0
""")
def _(v):
    out = N.call_orders(N.rides(v.patterns, 7), 7)
    return out.select("terminus", "place", "stop", "runs", "fastest", "every_run")


@query("r9_piece_loads", """
with l as (select *, max(pos) over (partition by trip) as last, lag(stop) over (partition by trip order by pos) as prev from {patterns}), b as (select trip, pos from l where stop = 7 and pos < last),
h as (select l.product, least(prev,l.stop) as a, greatest(prev,l.stop) as b, count(*) as runs from b join l on b.trip=l.trip and l.pos > b.pos group by 1,2,3)
select product, piece, sum(runs)::bigint as runs from (select product, runs, unnest(range(a, b)) as piece from h where b > a) group by 1,2
""")
def _(v):
    hops = N.hop_runs(N.rides(v.patterns, 7))
    paths = hops.where("b > a").select("a", "b").distinct().withColumn("path", F.sequence(F.col("a"), F.col("b") - 1).cast("array<bigint>"))
    return N.piece_loads(hops, paths)
