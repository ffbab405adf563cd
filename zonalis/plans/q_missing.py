"""Statistics of columns with planted NaN and infinities: the results of the columns without them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions import keys as K
from zonalis.operators import models as M
from zonalis.operators import ranking as R
from zonalis.operators import scoring as C
from zonalis.operators import stats as S
from zonalis.plans.catalogue import query
from zonalis.sources import sinks


def planted(v) -> DataFrame:
    """``(code, x, y)``: values of the areas, a fifth of which are NaN or infinite."""
    p, nan, inf = F.col("population"), F.lit(float("nan")), F.lit(float("inf"))
    x = F.when(p % 11 == 0, nan).when(p % 13 == 0, inf).when(p % 17 == 0, F.lit(None)).otherwise(F.col("acctbal").cast("double"))
    y = F.when(p % 19 == 0, nan).when(p % 23 == 0, -inf).otherwise(F.col("n_orders").cast("double"))
    return v.area_stats.select("code", x.alias("x"), y.alias("y"))


#: The same with NULL in their place.
CLEAN = """select code, case when population % 11 > 0 and population % 13 > 0 and population % 17 > 0 then acctbal::double end as x,
  case when population % 19 > 0 and population % 23 > 0 then n_orders::double end as y from {area_stats}"""


def line(df: DataFrame, what: str, n: str, value) -> DataFrame:
    return df.select(F.lit(what).alias("what"), F.col(n).cast("bigint").alias("n"), F.round(value, 6).alias("value"))


@query("f9_m1_m2_m3_m4_m6_planted_nan", f"""
with p as ({CLEAN}), b as (select * from p where x is not null and y is not null),
k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2e0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2e0 as ry from b),
z as (select (x - avg(x) over ()) / stddev_pop(x) over () as zx, (y - avg(y) over ()) / stddev_pop(y) over () as zy from b)
select 'pearson' as what, count(*) as n, round(corr(x, y), 6) as value from b union all select 'slope', count(*), round(regr_slope(y, x), 6) from b
union all select 'spearman', count(*), round(corr(rx, ry), 6) from k union all select 'matrix', count(*), round(corr(x, y), 6) from b
union all select 'gap', count(*), round(avg(abs(zx - zy)), 6) from z union all select 'agreement', count(*), round(avg(abs(zx * zy)), 6) from z
""")
def _(v):
    df = planted(v)
    one = S.pearson(df, "x", "y")
    far = lambda out, c: out.agg(F.count("*").alias("n"), F.avg(F.abs(c)).alias("value"))
    rows = [
        line(one, "pearson", "n", F.col("r")), line(one, "slope", "n", F.col("slope")), line(S.spearman(df, "x", "y"), "spearman", "n", F.col("rho")), line(S.correlation_matrix(df, ["x", "y"]), "matrix", "n", F.col("r")),
        line(far(S.gap(df, "x", "y"), "gap"), "gap", "n", F.col("value")), line(far(S.agreement(df, "x", "y"), "agreement"), "agreement", "n", F.col("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("o3_k5_w1_m12_m26_planted_nan", f"""
with p as ({CLEAN}), k as (select x, (rank() over (order by x) + (count(*) over (partition by x) - 1) / 2e0 - 0.5) / count(*) over () as mid from p where x is not null)
select 'columns' as what, count(x) + count(y) as n, round(coalesce(sum(x), 0) + coalesce(sum(y), 0), 6) as value from p union all select 'coverage', count(x), round(count(x) / count(*)::double, 6) from p
union all select 'p95', count(x), round(quantile_cont(x, 0.95), 6) from p union all select 'mid', count(*), round(avg(mid * x), 6) from k
union all select 'z', count(x), round(max((x - (select avg(x) from p)) / (select stddev_samp(x) from p)), 6) from p union all select 'number', count(x), round(sum(x), 6) from p
union all select 'desirability', count(x), round(avg(least(greatest(x / 5000, 0), 1)), 6) from p where x is not null
""")
def _(v):
    df = planted(v)
    agg = lambda rows, n, value: rows.agg(F.count(n).alias("n"), value.alias("value"))
    text = F.replace(F.col("x").cast("string"), F.lit("."), F.lit(","))
    criteria = [C.Criterion("x", bad=0.0, ideal=5000.0)]
    value = F.col("value")
    rows = [
        line(agg(sinks.stat_columns(df, ["x", "y"]), "value", F.sum("value")), "columns", "n", value), line(sinks.coverage(df, ["x"]), "coverage", "n", F.col("share")),
        line(C.criterion_profile(df, ["x"]), "p95", "n", F.col("p95")), line(agg(R.with_ranks(df, "x", m=R.mid_percentile()), "m", F.avg(F.col("m") * F.col("x"))), "mid", "n", value),
        line(agg(M.standardised(df, ["x"])[0], "z_x", F.max("z_x")), "z", "n", value), line(agg(df.withColumn("t", K.number(text)), "t", F.sum("t")), "number", "n", value),
        line(agg(C.with_desirabilities(df, criteria), "d0", F.avg("d0")), "desirability", "n", value),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
