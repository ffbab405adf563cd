"""Aggregation queries (A)."""

from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions import keys as K
from zonalis.operators import aggregates as A
from zonalis.plans import area_pipelines as P
from zonalis.plans.catalogue import query
from zonalis.plans.q_joins import squares


@query("a1_counts_and_sums", "select code, count(*) as fires, round(sum(ha),6) as ha, max(ha) as largest, max(year) as latest from {fires} group by 1")
def _(v):
    return v.fires.groupBy("code").agg(F.count("*").alias("fires"), F.round(F.sum("ha"), 6).alias("ha"), F.max("ha").alias("largest"), F.max("year").alias("latest"))


@query("a2_a3_sale_medians", """
with m as (select id_mutation, max(valeur) as value, count(distinct code) as nc, count(distinct type_local) as nt, min(code) as code, min(type_local) as kind, sum(surface) as surface from {sale_rows} group by 1)
select code, count(*) as sales, round(quantile_cont(value/surface, 0.5),6) as median, case when count(*) >= 2 then round(quantile_cont(value/surface, 0.9),6) end as p90 from m
where value > 0 and nc = 1 and nt = 1 and surface >= 9 and kind in ('A','N') and value/surface between 200 and 20000 group by 1
""")
def _(v):
    kept = A.sales(v.sale_rows, ["A", "N"], 9.0, (200.0, 20000.0))
    out = A.sale_medians(kept, [0.5, 0.9])
    return out.select("code", "sales", F.round(F.col("q")[0], 6).alias("median"), K.published_if(F.round(F.col("q")[1], 6), F.col("sales"), 2).alias("p90"))


@query("a4_a5_weighted_means", """
select dep, round(sum(avg_price*population)/sum(case when avg_price is not null then population end),6) as weighted, round(avg(avg_price),6) as plain, max(avg_price) as top from {area_stats} group by 1
""")
def _(v):
    price = F.col("avg_price")
    return v.area_stats.groupBy("dep").agg(F.round(A.weighted_mean(price, F.col("population")), 6).alias("weighted"), F.round(F.avg(price), 6).alias("plain"), F.max(price).alias("top"))


@query("a6_all_years_present", """
select code, case when count(distinct year) = 7 then round(avg(ha),6) end as mean, min(ha) as least, max(ha) as most from (select code, year, sum(ha) as ha from {fires} group by 1,2) group by 1
""")
def _(v):
    yearly = v.fires.groupBy("code", "year").agg(F.sum("ha").alias("ha"))
    return yearly.groupBy("code").agg(A.complete(F.round(F.avg("ha"), 6), F.col("ha"), 7).alias("mean"), F.min("ha").alias("least"), F.max("ha").alias("most"))


@query("a7_pivot", """
select code, max(case when opt='1-URGENT' then votes end) as urgent, max(case when opt='2-HIGH' then votes end) as high, max(case when opt='5-LOW' then votes end) as low from {votes} group by 1
""")
def _(v):
    wide = A.pivot_once(v.votes, ["code"], "opt", ["1-URGENT", "2-HIGH", "5-LOW"], "votes")
    return wide.withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query("a8_masked_group_sums", """
select code, case when bool_or(opt in ('1-URGENT','2-HIGH') and votes > 6) is not true then sum(case when opt in ('1-URGENT','2-HIGH') then votes end)::bigint end as fast,
 case when bool_or(opt in ('5-LOW') and votes > 6) is not true then sum(case when opt in ('5-LOW') then votes end)::bigint end as slow from {votes} group by 1
""")
def _(v):
    groups = {"fast": ["1-URGENT", "2-HIGH"], "slow": ["5-LOW"]}
    return v.votes.groupBy("code").agg(*A.group_sums(groups, "opt", F.col("votes"), F.col("votes") > 6))


@query("a9_distinct_slots", """
select code, count(distinct slot) as basket, count(distinct case when theme='A' then slot end) as a, count(distinct case when theme='N' then slot end) as n from (select code, type_local as theme, type_local||(surface::int % 7)::varchar as slot from {sale_rows}) group by 1
""")
def _(v):
    rows = v.sale_rows.select("code", F.col("type_local").alias("theme"), F.concat("type_local", (F.col("surface").cast("int") % 7).cast("string")).alias("slot"))
    return A.distinct_slots(rows, {"A": "a", "N": "n"})


@query("a10_a11_a12_strongest_and_flags", """
select code, case max(case type_local when 'A' then 3 when 'N' then 2 else 1 end) when 3 then 'A' when 2 then 'N' else 'R' end as state, bool_or(surface > 49) as large, max(surface) as most,
 array_to_string(list_sort(list(distinct type_local)),',') as kinds from {sale_rows} group by 1
""")
def _(v):
    return v.sale_rows.groupBy("code").agg(
        A.strongest(F.col("type_local"), ["A", "N"]).alias("state"), F.bool_or(F.col("surface") > 49).alias("large"), F.max("surface").alias("most"),
        A.sorted_set(F.col("type_local")).alias("kinds"))


@query("a13_nested_day_counts", """
select code, count(*) as days, count(*) filter (where worst >= 3) as severe, max(worst) as worst from (select code, annee, id_mutation, max(greatest(a,b,c)) as worst from (
 select code, annee, id_mutation, (surface::int % 5) as a, (surface::int % 3) as b, (surface::int % 4) as c from {sale_rows}) group by 1,2,3) group by 1
""")
def _(v):
    s = F.col("surface").cast("int")
    item = F.struct((s % 5).alias("a"), (s % 3).alias("b"), (s % 4).alias("c"))
    nested = v.sale_rows.groupBy("code", "annee", "id_mutation").agg(F.collect_list(item).alias("restrictions"))
    return A.day_counts(nested, "restrictions", ["a", "b", "c"], 3)


@query("a14_winners", """
select code, opt as winner, votes from (select *, row_number() over (partition by code order by votes desc, opt) as r from {votes}) where r = 1
""")
def _(v):
    position = F.substring("opt", 1, 1).cast("int")
    return v.votes.groupBy("code").agg(A.winner(F.col("opt"), F.col("votes"), position).alias("winner"), F.max("votes").alias("votes"))


@query("a15_a16_complete_years_and_seasons", """
with m as (select point, year, month, avg(tx) as tx, sum(precip) as precip from {daily_grid} group by 1,2,3)
select point, year, case when count(*) = 12 then round(sum(precip),6) end as precip, case when count(case when month between 6 and 8 then 1 end) = 3 then round(avg(case when month between 6 and 8 then tx end),6) end as summer from m group by 1,2
""")
def _(v):
    m = v.daily_grid.groupBy("point", "year", "month").agg(F.avg("tx").alias("tx"), F.sum("precip").alias("precip"))
    summer = A.in_months(F.col("tx"), F.col("month"), [6, 7, 8])
    return m.groupBy("point", "year").agg(A.complete(F.round(F.sum("precip"), 6), F.col("precip"), 12).alias("precip"), A.complete(F.round(F.avg(summer), 6), summer, 3).alias("summer"))


@query("a17_a19_month_summaries", """
with m as (select point, year, month, avg(tx) as tx, max(tx) as hottest, sum(case when precip >= 5 then 1 else 0 end)::bigint as wet, count(*) as days from {daily_grid} group by 1,2,3)
select point, month, round(avg(tx),4) as tx, max(hottest) as hottest, round(min(tx),4) as coolest, round(avg(wet),4) as wet, sum(days)::bigint as days from m group by 1,2
""")
def _(v):
    m = P.month_summaries(v.climate_days, rainy=5.0).where("month <= 12")
    days = v.daily_grid.groupBy("point", "month").agg(F.count("*").alias("days"))
    per = m.groupBy("point", "month").agg(F.round(F.avg("tx"), 4).alias("tx"), F.max("tx_max").cast("double").alias("hottest"), F.round(F.min("tx"), 4).alias("coolest"), F.round(F.avg("rainy"), 4).alias("wet"))
    return per.join(days, ["point", "month"])


@query("a18_shift_histogram", """
select point, shift, (select count(*) from {daily_grid} d where d.point = p.point and d.tx + shift >= 45) as days from (select distinct point from {daily_grid}) p, (select unnest(range(-10, 11))*0.5e0 as shift)
""")
def _(v):
    shifts = [i * 0.5 for i in range(-10, 11)]
    return A.shift_counts(v.daily_grid, ["point"], "tx", 0.5, shifts, 45.0)


@query("a20_season_shares", """
with m as (select point, month, sum(tx) as n from {daily_grid} group by 1,2), t as (select point, sum(n) as total from m group by 1 having count(*) = 12)
select m.point, round(100*sum(case when month between 6 and 9 then n else 0 end)/any_value(total),6) as summer, arg_max(month, round(n,6)) as peak, round(12*max(n)/any_value(total),6) as amplitude from m join t on m.point = t.point group by 1
""")
def _(v):
    m = v.daily_grid.groupBy("point", "month").agg(F.sum("tx").alias("n"))
    out = A.season_shares(m, "point", "n", [6, 7, 8, 9])
    return out.select("point", F.round("share", 6).alias("summer"), "peak", F.round("amplitude", 6).alias("amplitude"))


@query("a21_a22_age_bands_and_median", """
with h as (select lpad((l_suppkey)::varchar,5,'0') as code, l_quantity::int as age, count(*) as n from {lineitem} group by 1,2),
c as (select *, sum(n) over (partition by code order by age) as cum, sum(n) over (partition by code) as total from h),
md as (select code, round_even(age + (total/2e0 - (cum-n))/n, 1) as median from c where cum - n < total/2e0 and cum >= total/2e0)
select h.code, round(100e0*sum(case when age < 20 then n else 0 end)/sum(n),6) as young, round(100e0*sum(case when age >= 40 then n else 0 end)/sum(n),6) as old, any_value(median) as median from h join md on h.code=md.code group by 1
""")
def _(v):
    h = v.lineitem.groupBy(F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("code"), F.col("l_quantity").cast("int").alias("age")).agg(F.count("*").alias("n"))
    share = lambda c: F.round(A.share_where(c, F.col("n")), 6)
    bands = h.groupBy("code").agg(share(F.col("age") < 20).alias("young"), share(F.col("age") >= 40).alias("old"))
    return bands.join(A.histogram_median(h, ["code"], "age", "n"), "code")


@query("a23_a24_national_profile", """
select round(sum(avg_price*population)/sum(case when avg_price is not null then population end),6) as national, round(100e0*count(spend)/count(*),6) as present,
 round(quantile_cont(spend,0.1),6) as d1, round(quantile_cont(spend,0.5),6) as d5, round(quantile_cont(spend,0.9),6) as d9 from {area_stats}
""")
def _(v):
    out = A.national_profile(v.area_stats, "avg_price", "population", "spend", [0.1, 0.5, 0.9])
    return out.select(F.round("national", 6).alias("national"), F.round("present", 6).alias("present"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("d1", "d5", "d9"))])


@query("a25_pair_totals", """
select code, point, count(*) as n, round(sum(population::double),6) as population, round(sum(population*(lon-gx)),6) as offset_x from (select *, round_even(lon,0)+0e0 as gx, (round_even(lon,0)*100 + round_even(lat,0))::bigint as point from {areas}) group by 1,2
""")
def _(v):
    gx = F.rint("lon") + 0.0
    rows = v.areas.withColumns({"gx": gx, "point": (F.rint("lon") * 100 + F.rint("lat")).cast("bigint")})
    out = A.pair_totals(rows, ["code", "point"], "population", F.col("lon") - F.col("gx"))
    return out.select("code", "point", "n", F.round("weight", 6).alias("population"), F.round("offset", 6).alias("offset_x"))


@query("a26_describe", "select count(spend) as n, round(avg(spend),4) as mean, round(stddev_pop(spend),4) as sd, min(spend) as min, max(spend) as max from {area_stats}")
def _(v):
    out = v.area_stats.agg(*A.described("spend"))
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("a28_sequence_collapse", """
with t as (select trip, product, array_to_string(list(stop order by pos),'-') as stops, array_to_string(list(minutes order by pos),'-') as times, sum(minutes) as total from {patterns} group by 1,2)
select product, stops, count(*) as runs, min(total)::bigint as quickest from t group by 1,2
""")
def _(v):
    out = A.collapsed_sequences(v.patterns)
    quickest = F.aggregate("times", F.lit(0), lambda a, x: a + x).cast("bigint")
    return out.select("product", F.array_join(F.transform("stops", lambda s: s.cast("string")), "-").alias("stops"), "runs", quickest.alias("quickest"))


@query("a29_stop_service", """
select p.stop, count(distinct p.trip) as departures, count(distinct q.stop) filter (where q.stop <> p.stop) as destinations from {patterns} p join {patterns} q on p.trip = q.trip and p.pos < q.pos where p.product <> '5-LOW' group by 1
""")
def _(v):
    rail = v.patterns.where("product <> '5-LOW'")
    p = rail.select("trip", F.col("stop"), "pos")
    q = rail.select("trip", F.col("stop").alias("to"), F.col("pos").alias("later"))
    pairs = p.join(q, "trip").where("pos < later")
    # A trip's calls lie together: its stops and theirs are told apart there, and only pairs of stops travel.
    ahead = pairs.groupBy("trip", "stop").agg(F.collect_set("to").alias("ahead")).select("stop", F.posexplode_outer("ahead").alias("at", "to"))
    hops = ahead.groupBy("stop", "to").agg(F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("departures"))
    return hops.groupBy("stop").agg(F.sum("departures").alias("departures"), F.count_if(F.col("to") != F.col("stop")).alias("destinations"))


@query("a30_areas_and_lengths_by_class", """
select case when x0 < 0 then 'west' else 'east' end as side, count(*) as n, round(count(*)*0.25e0,6) as area, round(count(*)*2e0,6) as outline from {squares} group by 1
""")
def _(v):
    rows = squares(v).select(F.when(G.bounds(F.col("rings"))["min_x"] < 0, "west").otherwise("east").alias("side"), G.polygon_area(F.col("rings")).alias("a"), G.line_length(F.col("rings")[0]).alias("l"))
    out = A.measures_by_class(rows, "side", F.col("a"), F.col("l"))
    return out.select("side", "n", F.round("area", 6).alias("area"), F.round("length", 6).alias("outline"))


@query("a31_threshold_days", """
with y as (select point, year, count(*) filter (where tx >= 30 and month between 6 and 9) as days from {daily_grid} group by 1,2), k as (select count(distinct year) as k from {daily_grid})
select point, round(avg(days),6) as days from y group by 1 having count(*) = (select k from k)
""")
def _(v):
    out = A.threshold_days(v.daily_grid, "point", (F.col("tx") >= 30) & F.col("month").between(6, 9))
    return out.withColumn("days", F.round("days", 6))


@query("a32_cell_mean_height", """
select floor(lon)::bigint as cx, floor(lat)::bigint as cy, round(avg(coalesce(case when population > 10000 then acctbal end,0)),6) as height from {areas} group by 1,2
""")
def _(v):
    out = A.cell_mean(v.areas, F.when(F.col("population") > 10000, F.col("acctbal")))
    return out.select("cx", "cy", F.round("mean", 6).alias("height"))


@query("m34_interpolated_counts", """
with t as (select point, shift, (select count(*) from {daily_grid} d where d.point = p.point and d.tx + shift >= 45) as days from (select distinct point from {daily_grid}) p, (select unnest(range(-10, 11))*0.5e0 as shift)),
w as (select s_suppkey as point, (s_suppkey % 23 - 11)*0.47e0 as shift from {supplier}), c as (select *, least(greatest((shift+5)/0.5,0),20) as pos from w)
select c.point, c.shift, round(a.days*(1-(pos-least(floor(pos),19))) + b.days*(pos-least(floor(pos),19)),6) as days from c join t a on a.point=c.point and round((a.shift+5)/0.5)=least(floor(pos),19) join t b on b.point=c.point and round((b.shift+5)/0.5)=least(floor(pos),19)+1
""")
def _(v):
    table = A.shift_counts(v.daily_grid, ["point"], "tx", 0.5, [i * 0.5 for i in range(-10, 11)], 45.0)
    wanted = v.supplier.select(F.col("s_suppkey").alias("point"), ((F.col("s_suppkey") % 23 - 11) * 0.47).alias("shift"))
    return A.interpolated_counts(table, wanted, ["point"], 0.5, -5.0, 5.0).withColumn("days", F.round("days", 6))
