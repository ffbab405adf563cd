"""Rank, window and correlation queries (W, M1-M6)."""

from pyspark.sql import functions as F

from zonalis.functions import keys as K
from zonalis.operators import ranking as R
from zonalis.operators import stats as S
from zonalis.plans.catalogue import query
from zonalis.runtime import fresh_path

SPEND = "from {area_stats} where spend is not null"


@query("w1_w2_w3_rank_rules", f"""
with r as (select code, spend, acctbal, rank() over (order by acctbal) as lo, count(*) over (partition by acctbal) as c, count(*) over () as n from {{area_stats}})
select code, round((lo-1 + (c-1)/2.0 + 0.5)/n, 9) as pct, lo-1 + (c+1)/2.0 as average_rank, round(100e0*(lo-1)/(n-1),9) as below from r
""")
def _(v):
    out = R.with_ranks(v.area_stats, "acctbal", pct=F.round(R.mid_percentile(), 9), average_rank=R.average_rank(), below=F.round(R.share_below(), 9))
    return out.select("code", "pct", "average_rank", "below")


@query("w3_nulls_stay_null", f"""
select a.code, round(100e0*(r.lo-1)/(r.n-1),9) as below from {{area_stats}} a left join (select code, rank() over (order by spend) as lo, count(*) over () as n {SPEND}) r on a.code = r.code
""")
def _(v):
    return R.with_ranks(v.area_stats, "spend", below=F.round(R.share_below(), 9)).select("code", "below")


@query("w5_department_mean_position", f"""
with r as (select dep, population, 100e0*(rank() over (order by spend)-1)/(count(*) over ()-1) as below {SPEND}) select dep, round(sum(below*population)/sum(population),6) as position, count(*) as n from r group by 1
""")
def _(v):
    return R.group_position(v.area_stats, "spend", "dep", "population").withColumn("position", F.round("position", 6))


@query("w6_running_totals", "select point, day::varchar as day, sum(tx) over (partition by point order by day) as running, count(*) over (partition by point order by day) as days from {daily_grid}")
def _(v):
    total = lambda c: R.running(c, ["point"], "day")
    return v.daily_grid.select("point", F.col("day").cast("string").alias("day"), total(F.sum("tx")).alias("running"), total(F.count("*")).alias("days"))


@query("w7_consecutive_hops", """
with h as (select trip, pos, stop, lead(stop) over (partition by trip order by pos) as nxt, minutes - first_value(minutes) over (partition by trip order by pos) as since from {patterns})
select trip, pos, stop, nxt as next_stop, since from h where nxt is not null
""")
def _(v):
    since = F.col("minutes") - R.running(F.first("minutes"), ["trip"], "pos")
    out = R.consecutive(v.patterns.withColumn("since", since), ["trip"], "pos", "stop", "next_stop")
    return out.select("trip", "pos", "stop", "next_stop", "since")


@query("w8_cut_pieces", """
with c as (select point, tx as s, lead(tx) over (partition by point order by tx) as t from (select distinct point, tx from {daily_grid})) select point, count(*) as pieces, max(t - s) as longest from c where t - s >= 0.5 group by 1
""")
def _(v):
    cuts = R.consecutive(v.daily_grid.select("point", F.col("tx").alias("s")).distinct(), ["point"], "s", "s", "t")
    return cuts.where(F.col("t") - F.col("s") >= 0.5).groupBy("point").agg(F.count("*").alias("pieces"), F.max(F.col("t") - F.col("s")).alias("longest"))


@query("w9_folds", "select s_suppkey % 10 as fold, count(*) as n, min(s_suppkey) as first from {supplier} group by 1")
def _(v):
    return v.supplier.groupBy(R.fold(F.col("s_suppkey")).alias("fold")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


@query("w10_top_k_and_share", f"""
with t as (select code, spend {SPEND} order by spend desc, code limit 50), a as (select sum(spend) as total {SPEND})
select code, spend, round(100*(select sum(spend) from t)/total,6) as share from t, a
""")
def _(v):
    return R.top_share(v.area_stats, "spend", "code", 50).withColumn("share", F.round("share", 6))


@query("w11_total_order", "select code, spend, row_number() over (order by spend desc, code) as place from {area_stats} where spend is not null")
def _(v):
    return R.distributed_row_number(v.area_stats.where("spend is not null").select("code", "spend"), [F.col("spend").desc(), F.col("code")], "place")


SEARCH = """
with m as (select p_partkey, p_name, p_size, lower(p_name) as f from {part}), h as (select *, case when f = 'red wi' then 0 when strpos(f,'red')=1 then 1 when regexp_matches(f,'(^| )red') and regexp_matches(f,'(^| )wi') then 2 else 3 end as rank
 from m where contains(f,'red') and contains(f,'wi')) select p_partkey, p_name, rank from h order by rank, p_size desc, p_name, p_partkey limit 60
"""


@query("w12_search_ranking", SEARCH)
def _(v):
    from zonalis.plans.search import search

    rows = v.part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("population"))
    return search(rows, "Red wi").select(F.col("code").cast("bigint").alias("p_partkey"), F.col("name").alias("p_name"), "rank")


@query("w12_token_search", SEARCH)
def _(v):
    """The same from a written table of tokens."""
    from zonalis.plans.search import search_tokens, write_token_table

    rows = v.part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("population"))
    path = fresh_path(v.spark, "tokens")
    write_token_table(rows, path)
    return search_tokens(v.spark.read.parquet(path), "Red wi").select(F.col("code").cast("bigint").alias("p_partkey"), F.col("name").alias("p_name"), "rank")


@query("w13_movers", """
with b as (select code, spend, avg_price from {area_stats} where spend is not null and avg_price is not null), r as (select code, 100*percent_rank() over (order by spend) as a, 100*percent_rank() over (order by avg_price) as b from b)
select code, round(a-b,6) as move from r order by abs(round(a-b,6)) desc, code limit 20
""")
def _(v):
    return R.movers(v.area_stats, "spend", "avg_price", "code", 20)


@query("w14_scatter_sample", """
with b as (select *, row_number() over (order by code) as rn, count(*) over () as n from {area_stats} where spend is not null and avg_price is not null),
q as (select quantile_cont(spend,0.01) as a, quantile_cont(spend,0.99) as b, quantile_cont(avg_price,0.01) as c, quantile_cont(avg_price,0.99) as d from b)
select code, spend, avg_price from b, q where (rn-1) % ceil(n/300.0)::bigint = 0 and spend between a and q.b and avg_price between c and d
""")
def _(v):
    return S.scatter_sample(v.area_stats, "spend", "avg_price", [F.col("code")], 300).select("code", "spend", "avg_price")


@query("m1_pearson", "select count(*) as n, round(corr(avg_price, spend),9) as r, round(regr_slope(avg_price, spend),9) as slope, round(regr_intercept(avg_price, spend),3) as intercept from {area_stats} where spend is not null and avg_price is not null")
def _(v):
    return S.pearson(v.area_stats, "spend", "avg_price").select("n", F.round("r", 9).alias("r"), F.round("slope", 9).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("m2_spearman", """
with b as (select spend, avg_price from {area_stats} where spend is not null and avg_price is not null), r as (select rank() over (order by spend) + (count(*) over (partition by spend)-1)/2.0 as a, rank() over (order by avg_price) + (count(*) over (partition by avg_price)-1)/2.0 as b from b)
select count(*) as n, round(corr(a,b),9) as rho from r
""")
def _(v):
    return S.spearman(v.area_stats, "spend", "avg_price").withColumn("rho", F.round("rho", 9))


@query("m3_m4_agreement_and_gap", """
with b as (select code, spend, avg_price from {area_stats} where spend is not null and avg_price is not null), s as (select avg(spend) as mx, stddev_pop(spend) as sx, avg(avg_price) as my, stddev_pop(avg_price) as sy from b)
select code, round((spend-mx)/sx*((avg_price-my)/sy),6) as agreement, round((spend-mx)/sx-(avg_price-my)/sy,6) as gap from b, s
""")
def _(v):
    both = S.gap(S.agreement(v.area_stats, "spend", "avg_price"), "spend", "avg_price")
    return both.select("code", F.round("agreement", 6).alias("agreement"), F.round("gap", 6).alias("gap"))


def _local_sql(radius: int) -> str:
    return f"""
with b as (select code, lon, lat, spend as x, avg_price as y from {{area_stats}} where spend is not null and avg_price is not null),
p as (select a.code, b.x, b.y, sqrt(((b.lon-a.lon)*111.320*cos(radians(a.lat)))**2 + ((b.lat-a.lat)*110.574)**2) as d from b a, b where abs(b.lat-a.lat) < {3 * radius / 110}),
c as (select code, count(*) filter (where d <= {radius}) as n1, count(*) filter (where d <= {2 * radius}) as n2, count(*) filter (where d <= {3 * radius}) as n3 from p group by 1),
u as (select code, case when n1 >= 12 then {radius} when n2 >= 12 then {2 * radius} when n3 >= 12 then {3 * radius} end as radius from c)
select u.code, round(case when var_pop(x)*count(x) > 1e-12 and var_pop(y)*count(x) > 1e-12 then corr(x,y) end,6) as r, nullif(count(x),0) as n, any_value(radius)::double as radius from u left join p on p.code=u.code and d <= radius group by 1
"""


@query("m5_local_correlation", _local_sql(80))
def _(v):
    return S.local_correlation(v.area_stats, "spend", "avg_price", 80.0).withColumn("r", F.round("r", 6))


@query("m5_local_correlation_widening", _local_sql(25))
def _(v):
    return S.local_correlation(v.area_stats, "spend", "avg_price", 25.0).withColumn("r", F.round("r", 6))


@query("m6_correlation_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) filter (where {a} is not null and {b} is not null) as n, round(corr({a},{b}),9) as r from {{area_stats}}" for a, b in (("spend", "avg_price"), ("spend", "acctbal"), ("spend", "population"), ("avg_price", "acctbal"), ("avg_price", "population"), ("acctbal", "population"))))
def _(v):
    return S.correlation_matrix(v.area_stats, ["spend", "avg_price", "acctbal", "population"]).select("a", "b", "n", F.round("r", 9).alias("r"))


@query("k25_name_tokens", "select code, n from (select lpad(c_custkey::varchar,5,'0') as code, len([x for x in string_split(lower(replace(c_name,'#',' ')),' ') if x <> '']) as n from {customer})")
def _(v):
    return v.areas.select("code", F.size(F.filter(F.split(K.folded_name(F.col("name")), " "), lambda t: t != "")).cast("bigint").alias("n"))
