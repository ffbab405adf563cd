"""Model queries."""

from pyspark.sql import functions as F

from zonalis.operators import models as M
from zonalis.plans.catalogue import query


def fire_rows(v):
    """Counts of large fires per area with features and exposure."""
    counts = v.fires.where("year <= 1999").groupBy("code").agg(F.count_if(F.col("ha") > 6).alias("big"))
    rows = v.area_stats.join(counts, "code", "left").fillna({"big": 0})
    return rows.select("code", "lon", "lat", F.log1p("population").alias("people"), F.col("acctbal").alias("money"), F.col("n_orders").cast("double").alias("orders"), F.col("big").cast("double").alias("big"), (1.0 + F.col("population") / 10_000.0).alias("exposure"))


@query("m25_neighbour_rate", """
with c as (select a.code, a.lon, a.lat, 1e0+a.population/1000e0 as area, coalesce(f.n,0) as n from {areas} a left join (select code, count(*) as n from {fires} group by 1) f on a.code=f.code),
r as (select a.code, sum(b.n)*10000e0/(sum(b.area)*7) as rate from c a join c b on a.code <> b.code and sqrt((a.lon-b.lon)**2+(a.lat-b.lat)**2) <= 0.5 group by 1) select c.code, round(coalesce(rate,0),6) as rate from c left join r on c.code=r.code
""")
def _(v):
    counts = v.fires.groupBy("code").agg(F.count("*").alias("events"))
    areas = v.areas.join(counts, "code", "left").fillna({"events": 0})
    areas = areas.select("code", F.col("lon").alias("x"), F.col("lat").alias("y"), "events", (1.0 + F.col("population") / 1000.0).alias("area"))
    return M.neighbour_rate(areas, 0.5, 7).withColumn("rate", F.round("rate", 6))


@query("m26_standardised", "with s as (select avg(acctbal) as m, stddev_samp(acctbal) as s from {areas}) select code, round((acctbal-m)/s,6) as z from {areas}, s")
def _(v):
    out, _ = M.standardised(v.areas.select("code", "acctbal"), ["acctbal"])
    return out.select("code", F.round("z_acctbal", 6).alias("z"))


@query("m27_m28_poisson_model")
def _(v):
    rows, _ = M.standardised(fire_rows(v), ["people", "money", "orders"])
    features = ["z_people", "z_money", "z_orders"]
    beta = M.fit_poisson(rows, features, "big", "exposure", 1.0)
    out = M.with_prediction(rows, features, beta, "exposure")
    return out.crossJoin(F.broadcast(M.dispersion(out, "big", len(beta)))).select("code", "big", F.round("expected", 6).alias("expected"), F.round("dispersion", 6).alias("dispersion"))


#: Coefficients of the rows that SQL can check: intercept, people, money, orders.
STATED = (-0.5, 0.3, -0.2, 0.1)


@query("m28_predicted_counts", f"""
with c as (select code, count(*) filter (where ha > 6) as big from {{fires}} where year <= 1999 group by 1), r as (select a.code, ln(1+population) as p, acctbal as m, n_orders::double as o, coalesce(big,0)::double as big, 1e0+population/1e4 as x from {{area_stats}} a left join c on c.code=a.code),
s as (select avg(p) as mp, stddev_samp(p) as sp, avg(m) as mm, stddev_samp(m) as sm, avg(o) as mo, stddev_samp(o) as so from r), e as (select code, big, x*exp({STATED[0]}e0+{STATED[1]}e0*(p-mp)/sp+{STATED[2]}e0*(m-mm)/sm+{STATED[3]}e0*(o-mo)/so) as expected from r, s)
select code, big, round(expected,6) as expected, round((select sum((big-expected)**2/expected)/(count(*)-4) from e),6) as dispersion from e
""")
def _(v):
    rows, _ = M.standardised(fire_rows(v), ["people", "money", "orders"])
    out = M.with_prediction(rows, ["z_people", "z_money", "z_orders"], STATED, "exposure")
    return out.crossJoin(F.broadcast(M.dispersion(out, "big", len(STATED)))).select("code", "big", F.round("expected", 6).alias("expected"), F.round("dispersion", 6).alias("dispersion"))


@query("p26_m29_season_quality", """
with a as (select code, (population*7919 % 1000)/1000e0 as rate, (population*7919 % 1000)/1000e0*(1e0+population/1000e0) as expected, (population % 40)::double as weather from {area_stats}),
k as (select *, rank() over (order by rate) + (count(*) over (partition by rate)-1)/2.0 as r1, rank() over (order by expected) + (count(*) over (partition by expected)-1)/2.0 as r2, rank() over (order by weather) + (count(*) over (partition by weather)-1)/2.0 as r3, count(*) over () as n, (select quantile_cont(rate,0.9) from a) as edge from a),
h as (select distinct code, year from {fires} where ha > 6 and year between 1996 and 1997)
select year, count(*) as hit, round((sum(r1)-count(*)*(count(*)+1)/2.0)/(count(*)*(any_value(n)-count(*))),9) as auc_rate, round((sum(r2)-count(*)*(count(*)+1)/2.0)/(count(*)*(any_value(n)-count(*))),9) as auc_expected,
round((sum(r3)-count(*)*(count(*)+1)/2.0)/(count(*)*(any_value(n)-count(*))),9) as auc_weather, round(count(*) filter (where rate >= edge)/count(*)::double,9) as capture from h join k using (code) group by 1
""")
def _(v):
    rate = (F.col("population") * 7919 % 1000) / F.lit(1000.0)
    areas = v.area_stats.select("code", rate.alias("rate"), (rate * (1.0 + F.col("population") / 1000.0)).alias("expected"), (F.col("population") % 40).cast("double").alias("weather"))
    hits = v.fires.where("year between 1996 and 1997").groupBy("code", "year").agg(F.count_if(F.col("ha") > 6).alias("n"))
    out = M.season_quality(areas, hits, ["rate", "expected", "weather"], "rate")
    return out.select("year", "hit", *[F.round(c, 9).alias(c) for c in ("auc_rate", "auc_expected", "auc_weather", "capture")])


@query("m29_auc_and_capture", """
with c as (select a.code, a.acctbal, coalesce(f.n,0) as n from {areas} a left join (select code, count(*) filter (where ha > 9) as n from {fires} group by 1) f on a.code=f.code),
r as (select *, rank() over (order by acctbal) + (count(*) over (partition by acctbal)-1)/2.0 as rk, n > 3 as hit from c)
select round((sum(case when hit then rk end) - sum(hit::int)*(sum(hit::int)+1)/2.0)/(sum(hit::int)*sum((not hit)::int)),9) as auc, round((select sum(n) from (select n from c order by acctbal desc, code limit (select round(count(*)*0.1)::bigint from c)))/sum(n),9) as capture from r
""")
def _(v):
    counts = v.fires.groupBy("code").agg(F.count_if(F.col("ha") > 9).alias("n"))
    rows = v.areas.join(counts, "code", "left").fillna({"n": 0}).select("code", "acctbal", "n", (F.col("n") > 3).alias("hit"))
    return M.auc(rows, "acctbal", "hit").crossJoin(M.top_capture(rows, "acctbal", "n", "code")).select(F.round("auc", 9).alias("auc"), F.round("capture", 9).alias("capture"))


@query("m31_m32_cross_validated_lines", """
with r as (select month, point, point % 10 as fold, precip/10e0 as x, tx as y from {daily_grid}), f as (select month, fold, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x*x) as sxx, sum(x*y) as sxy from r group by 1,2),
t as (select month, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from f group by 1),
h as (select f.month, f.fold, ((t.n-f.n)*(t.sxy-f.sxy)-(t.sx-f.sx)*(t.sy-f.sy))/((t.n-f.n)*(t.sxx-f.sxx)-(t.sx-f.sx)**2) as b, t.n-f.n as n, t.sx-f.sx as sx, t.sy-f.sy as sy from f join t on f.month=t.month),
e as (select r.month, x, y - ((sy-b*sx)/n + b*x) as err from r join h on r.month=h.month and r.fold=h.fold)
select t.month, round((t.n*t.sxy-t.sx*t.sy)/(t.n*t.sxx-t.sx**2),5) as b, t.n::bigint as n, round(q.rmse,5) as rmse, round(q.far,5) as rmse_far from t join (select month, sqrt(avg(err*err)) as rmse, sqrt(avg(case when abs(x) > 0.3 then err*err end)) as far from e group by 1) q on t.month=q.month
""")
def _(v):
    rows = v.daily_grid.select("month", "point", (F.col("precip") / 10.0).alias("x"), F.col("tx").alias("y"))
    fits, _ = M.cross_validated_line(rows, ["month"], "x", "y", F.pmod("point", F.lit(10)))
    return fits.select("month", F.round("b", 5).alias("b"), "n", F.round("rmse", 5).alias("rmse"), F.round("rmse_far", 5).alias("rmse_far"))


@query("m33_m35_factors_and_errors", """
with f as (select month, quantile_cont(tx/precip,0.5) as factor, count(*) as n from {daily_grid} where precip >= 0.5 group by 1)
select d.month, round(any_value(factor),6) as factor, any_value(f.n) as n, round(avg(precip*factor-tx),5) as bias, round(avg(abs(precip*factor-tx)),5) as mae, round(sqrt(avg((precip*factor-tx)**2)),5) as rmse, round(quantile_cont(case when tx <> 0 then abs((precip*factor-tx)/tx) end,0.5),5) as median_relative from {daily_grid} d join f on d.month=f.month group by 1
""")
def _(v):
    factors = M.monthly_factors(v.daily_grid, "tx", "precip")
    rows = v.daily_grid.join(F.broadcast(factors), "month").withColumn("err", F.col("precip") * F.col("factor") - F.col("tx"))
    out = M.error_summary(rows, ["month"], "err", "tx").join(factors, "month")
    return out.select("month", F.round("factor", 6).alias("factor"), "n", *[F.round(c, 5).alias(c) for c in ("bias", "mae", "rmse", "median_relative")])


@query("m36_area_climate_table", """
with p as (select a.code, a.population, v.venue_id as point from {areas} a join {venues} v on round_even(a.lon,0)=round_even(v.lon,0) and round_even(a.lat,0)=round_even(v.lat,0)), m as (select point, month, avg(tx) as tx, sum(precip) as precip from {daily_grid} group by 1,2),
a as (select code, month, sum(tx*population)/sum(population) as tx, sum(precip*population)/sum(population) as precip from p join m on p.point=m.point group by 1,2)
select code, month, round(tx,5) as tx, round(precip,4) as precip from a union all select code, 13, round(max(tx),5), round(sum(precip),4) from a group by 1
""")
def _(v):
    cell = lambda c: F.rint(c) + 0.0
    points = v.venues.select(F.col("venue_id").alias("point"), cell("lon").alias("gx"), cell("lat").alias("gy"))
    # People and points meet as sums of a cell, not one by one.
    people = v.areas.groupBy("code", cell("lon").alias("gx"), cell("lat").alias("gy")).agg(F.sum("population").alias("people"))
    monthly = v.daily_grid.groupBy("point", "month").agg(F.avg("tx").alias("tx"), F.sum("precip").alias("precip"))
    cells = points.join(monthly, "point").groupBy("gx", "gy", "month").agg(F.sum("tx").alias("tx"), F.sum("precip").alias("precip"), F.count("*").alias("n"))
    w = F.col("people")
    table = people.join(cells, ["gx", "gy"]).groupBy("code", "month").agg(*[(F.sum(F.col(c) * w) / F.sum(F.col("n") * w)).alias(c) for c in ("tx", "precip")])
    year = table.groupBy("code").agg(F.lit(13).alias("month"), F.max("tx").alias("tx"), F.sum("precip").alias("precip"))
    return table.unionByName(year).select("code", "month", F.round("tx", 5).alias("tx"), F.round("precip", 4).alias("precip"))
