"""Registered queries of the area-statistics operators and their oracle SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonalis.runtime import bounded_tasks, own_tasks

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events documents".split()

#: Views over the given tables, in SQL that Spark and DuckDB both read.
VIEWS = {
    "areas": """select lpad(cast(c_custkey as string),5,'0') as code, lpad(cast(c_nationkey as string),2,'0') as dep,
        -5e0 + (c_custkey*7919 % 14000)/1000e0 as lon, 41.5e0 + (c_custkey*104729 % 9500)/1000e0 as lat,
        1 + c_custkey*7907 % 50000 as population, c_acctbal as acctbal, c_name as name from {customer}""",
    "order_sums": """select lpad(cast(o_custkey as string),5,'0') as code, count(*) as n, sum(o_totalprice) as total from {orders} group by 1""",
    "area_stats": """select a.code, a.dep, a.lon, a.lat, a.population, a.acctbal, coalesce(o.n,0) as n_orders,
        case when o.n >= 8 then o.total end as spend, case when o.n >= 5 then o.total/o.n end as avg_price
        from {areas} a left join {order_sums} o on a.code=o.code""",
    "venues": """select s_suppkey as venue_id, case s_suppkey % 3 when 0 then 'scene' when 1 then 'musee' else 'festival' end as categorie,
        -5e0 + (s_suppkey*6007 % 14000)/1000e0 as lon, 41.5e0 + (s_suppkey*15013 % 9500)/1000e0 as lat, cast(1 + s_suppkey % 10 as double) as poids from {supplier}""",
    "sale_rows": """select l_orderkey as id_mutation, lpad(cast(o_custkey as string),5,'0') as code, o_totalprice as valeur,
        l_returnflag as type_local, l_quantity as surface, cast(year(o_orderdate) as int) as annee from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    "fires": """select lpad(cast(o_custkey as string),5,'0') as code, cast(year(l_shipdate) as int) as year, l_extendedprice/10000e0 as ha
        from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    "daily_grid": """select l_suppkey as point, cast(l_shipdate as date) as day, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
        max(l_quantity) as tx, max(l_discount)*100e0 as precip from {lineitem} group by 1,2,3,4""",
    "climate_days": """select point, day, year, month, cast(tx as double) as tx, tx - 12e0 - precip/10 as tn, tx - 5e0 as t, precip, 40e0 + tx/2 as hu, tx*20e0 as ssi from {daily_grid}""",
    "patterns": """select l_orderkey as trip, o_orderpriority as product, cast(l_suppkey % 50 as int) as stop, cast(l_quantity as int) as minutes,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as pos
        from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    "votes": """select lpad(cast(o_custkey as string),5,'0') as code, o_orderpriority as opt, count(*) as votes from {orders} group by 1,2""",
    "squares": """select distinct 'P'||cast(cast(floor(lon*2) as int) as string)||'_'||cast(cast(floor(lat*2) as int) as string) as poly,
        cast(floor(lon*2) as int)/2e0 as x0, cast(floor(lat*2) as int)/2e0 as y0 from {areas} where (population % 3) > 0""",
}

_DECIMAL = "try_cast(o_totalprice as decimal(28,10))"

#: Views that Spark makes otherwise: sums of orders don't depend on the order of addition, so that equal orders tie.
#: Where a price is no decimal of ten digits the sum is that of doubles.
SPARK_VIEWS = {
    "order_sums": f"""select lpad(cast(o_custkey as string),5,'0') as code, count(*) as n,
        case when bool_and(cast({_DECIMAL} as double) <=> o_totalprice) then cast(sum({_DECIMAL}) as double) else sum(o_totalprice) end as total from {{orders}} group by 1""",
}

#: Tables whose rows meet by order, and their keys.
BY_ORDER = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


class Views:
    """Attribute access to the given tables and the views over them.

    Where a view joins line items to their orders and there are more than runtime.own_tasks() can hold, both are dealt
    by order to as many as runtime.bounded_tasks() says, a number that adaptive execution leaves alone; windows and
    groups of an order stay there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._made.setdefault(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.sql(SPARK_VIEWS.get(name, VIEWS[name]))
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{([a-z]\w*)\}", text))
        tables = {n: getattr(self, n) for n in names}
        if names >= set(BY_ORDER):
            tasks = bounded_tasks(self.lineitem)
            if tasks > own_tasks(self.spark):
                tables |= {n: tables[n].repartition(tasks, key) for n, key in BY_ORDER.items()}
        return self.spark.sql(text, **tables)


_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def oracle_of(sql: str) -> str:
    """The statement with the views that it names, in order of their dependence."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", text)
    views = [f"{n} as ({plain(VIEWS[n])})" for n in needed]
    body = plain(sql).strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join([*views, body[15:]])
    if body.lower().startswith("with "):
        views.append(body[5:])
        return "with " + ", ".join(views)
    return f"with {', '.join(views)} {body}" if views else body


def query(name: str, sql: str | None = None):
    """Registers ``fn(views)`` and, where SQL can express it, the oracle with {view} names."""

    def add(fn):
        _QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            _ORACLE[name] = oracle_of(sql)
        return fn

    return add


MODULES = ["q_scalars", "q_joins", "q_aggregates", "q_ranks", "q_scores", "q_models", "q_missing", "q_geometry", "q_networks", "q_contract", "q_sources", "q_more", "q_pipelines", "q_pipelines_more"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"zonalis.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
