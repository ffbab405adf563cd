"""Scalar, filter and dedup queries (K, F, D)."""

from pyspark.sql import functions as F

from zonalis.functions import keys as K
from zonalis.operators import dedup
from zonalis.plans import area_pipelines as P
from zonalis.plans import feature_pipelines as Q
from zonalis.plans.catalogue import query


@query("k1_normalise_code", """
select c_custkey, raw, case when regexp_matches(t2, '^([0-9]{5}|2[AB][0-9]{3})$') then t2 end as code from (
 select c_custkey, raw, case when regexp_matches(t, '^[0-9]{1,4}$') then lpad(t,5,'0') else t end as t2 from (
  select c_custkey, raw, regexp_replace(upper(trim(raw)), '\\.0$', '') as t from (
   select c_custkey, case c_custkey % 5 when 0 then ' '||c_custkey::varchar||' ' when 1 then c_custkey::varchar||'.0' when 2 then '2a'||lpad((c_custkey%1000)::varchar,3,'0') when 3 then 'x'||c_custkey::varchar else '' end as raw from {customer})))
""")
def _(v):
    key = F.col("c_custkey")
    raw = (
        F.when(key % 5 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit(" ")))
        .when(key % 5 == 1, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 5 == 2, F.concat(F.lit("2a"), F.lpad((key % 1000).cast("string"), 3, "0")))
        .when(key % 5 == 3, F.concat(F.lit("x"), key.cast("string")))
        .otherwise("")
    )
    return v.customer.select("c_custkey", raw.alias("raw")).withColumn("code", K.normalise_code(F.col("raw")))


@query("k2_k3_k4_departments", """
select code, substr(code,1,2) not in ('97','98','99') as metro, case when substr(code,1,2) in ('97','98') then substr(code,1,3) else substr(code,1,2) end as dep3,
 substr(code,1,2)||lpad((population % 1000)::varchar,3,'0') as built from (select ((97 + c_custkey % 4)::varchar) || '0' || (c_custkey % 90 + 10)::varchar as code0,
 lpad(((c_custkey * 977) % 100000)::varchar,5,'0') as code, 1 + c_custkey*7907 % 50000 as population from {customer})
""")
def _(v):
    rows = v.customer.select(F.lpad(((F.col("c_custkey") * 977) % 100000).cast("string"), 5, "0").alias("code"), (1 + F.col("c_custkey") * 7907 % 50000).alias("population"))
    code = F.col("code")
    return rows.select("code", K.is_metropolitan(code).alias("metro"), K.department(code).alias("dep3"), K.joined_code(F.substring(code, 1, 2), F.col("population") % 1000).alias("built"))


@query("k5_k6_numbers", """
select o_orderkey, try_cast(replace(replace(replace(raw,'%',''),',','.'),' ','') as double) as value, case when raw2 not in ('s','ND','') then try_cast(replace(raw2,',','.') as double) end as kept
from (select o_orderkey, case when o_orderkey % 7 = 0 then '-' else replace((o_orderkey % 1000 / 10e0)::varchar,'.',',')||' %' end as raw,
 case o_orderkey % 4 when 0 then 's' when 1 then 'ND' when 2 then '' else (o_orderkey % 50)::varchar||',5' end as raw2 from {orders})
""")
def _(v):
    k = F.col("o_orderkey")
    raw = F.when(k % 7 == 0, "-").otherwise(F.concat(F.replace((k % 1000 / 10.0).cast("string"), F.lit("."), F.lit(",")), F.lit(" %")))
    raw2 = F.when(k % 4 == 0, "s").when(k % 4 == 1, "ND").when(k % 4 == 2, "").otherwise(F.concat((k % 50).cast("string"), F.lit(",5")))
    return v.orders.select("o_orderkey", K.number(raw).alias("value"), K.suppressed_number(raw2).alias("kept"))


@query("k7_k8_k9_codes", """
select p_partkey, right(lpad(p_partkey::varchar||'87', greatest(8, length(p_partkey::varchar)+2)::int,'0'),8) as uic,
 case when p_type ilike '%a%' then 'A' when p_type ilike '%b%' then 'B' when p_type ilike '%c%' then 'C' end as grade,
 case when p_size >= 45 then 100 else p_size end as age from {part}
""")
def _(v):
    has = lambda g: F.when(F.upper("p_type").contains(g), F.lit(f" {g.lower()} ")).otherwise("")
    packed = F.concat_ws(";", has("C"), has("B"), has("A"))
    age = F.when(F.col("p_size") >= 45, "Y_GE100").otherwise(F.concat(F.lit("Y"), F.col("p_size").cast("string")))
    return v.part.select("p_partkey", K.uic8(F.concat(F.col("p_partkey").cast("string"), F.lit("/87.0"))).alias("uic"), K.best_grade(packed).alias("grade"), K.age_index(age).cast("int").alias("age"))


@query("k10_k11_clock_and_week", """
select event_id, minute_of, strftime(monday, '%Y-%m-%d') as monday, strftime(monday + interval 6 day, '%Y-%m-%d') as sunday from (select event_id, (event_id % 30) * 60 + event_id % 60 as minute_of,
 (d + (8 - isodow(d))::int % 7) as monday from (select event_id, (ts::date + 7) as d from {events}))
""")
def _(v):
    k = F.col("event_id")
    clock = F.concat_ws(":", F.lpad((k % 30).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("00"))
    week = K.typical_week(F.to_date("ts"))
    return v.events.select("event_id", K.clock_minutes(clock).cast("bigint").alias("minute_of"), week[0].cast("string").alias("monday"), week[6].cast("string").alias("sunday"))


@query("k12_k13_stops_and_plans", """
select s_suppkey, 'TGV'||(s_suppkey % 4)::varchar as product, lpad(s_suppkey::varchar,8,'0') as code,
 case s_suppkey % 6 when 0 then 'approuve' when 1 then 'approuve' when 2 then 'prescrit' when 3 then 'prescrit' when 4 then 'caduque' end as state from {supplier}
""")
def _(v):
    k = F.col("s_suppkey")
    parts = K.stop_parts(F.concat(F.lit("StopPoint:OCETGV"), (k % 4).cast("string"), F.lit("-"), F.lpad(k.cast("string"), 8, "0")))
    stage = F.when(k % 6 == 0, "Opposable").when(k % 6 == 2, " Prescrit ").when(k % 6 == 4, "Caduque")
    detail = F.when(k % 6 == 1, "Approuvé").when(k % 6 == 3, "Anticipé").when(k % 6 == 5, "Autre")
    return v.supplier.select("s_suppkey", *[c.alias(n) for n, c in parts.items()], K.plan_state(stage, detail).alias("state"))


@query("k14_k15_k16_weights", """
select o_orderkey, y as year, round(reach::double * case when y < 1990 then 1.5 when y < 2010 then 1.2 else 1.0 end, 2)::double as weight,
 round(least(greatest(1 + log10(o_totalprice / 10000), 0.5), 6.0), 9) as museum from (select o_orderkey, o_totalprice, 1980 + o_orderkey % 40 as y,
 case o_orderkey % 5 when 0 then 3.0 when 1 then 3.0 when 2 then 2.0 when 3 then 1.3 else 1.0 end as reach from {orders})
""")
def _(v):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "Inernationale").when(k % 5 == 1, "nationale").when(k % 5 == 2, "Région").when(k % 5 == 3, "DÉPARTEMENTALE")
    year = K.founding_year(F.concat(F.lit("01/01/"), (1980 + k % 40).cast("string"), F.lit(".0")))
    return v.orders.select("o_orderkey", year.cast("bigint").alias("year"), K.reach_weight(text, year).alias("weight"), F.round(K.museum_weight(F.col("o_totalprice")), 9).alias("museum"))


@query("k17_k19_spans_and_classes", """
select l_orderkey, l_partkey, l_suppkey, l_quantity, round(l_quantity + 0.5e0, 6) as days, l_quantity as plain, case when l_quantity <= 1 then 'desert' when l_quantity <= 3 then 'tres_limite' when l_quantity <= 7 then 'limite' when l_quantity <= 14 then 'correct' else 'complet' end as service,
 case when l_quantity >= 40 then 4 when l_quantity >= 20 then 6 when l_quantity >= 10 then 8 else 8 end as zoom,
 case when l_tax > 0.07 then 'supermarche' when l_tax > 0.05 then 'proximite' when l_tax > 0.03 then 'specialise' else 'aucun' end as food,
 case when l_tax > 0.04 and l_discount > 0.05 then 'les_deux' when l_tax > 0.04 then 'submersion' when l_discount > 0.05 then 'recul' else 'aucun' end as coast from {lineitem}
""")
def _(v):
    q = F.col("l_quantity")
    over = lambda c, x: F.col(c) > x
    service = K.step_class(q, [(1, "desert"), (3, "tres_limite"), (7, "limite"), (14, "correct")], "complet")
    return v.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.round(K.span_days(F.concat(q.cast("int").cast("string"), F.lit(" days 12:00:00"))), 6).alias("days"),
        K.span_days(q.cast("string")).alias("plain"), service.alias("service"), K.floor_tier(q, [(40, 4), (20, 6), (10, 8)]).alias("zoom"),
        K.food_class(over("l_tax", 0.07).cast("int"), over("l_tax", 0.05).cast("int"), over("l_tax", 0.03).cast("int")).alias("food"),
        K.coast_class(over("l_tax", 0.04), over("l_discount", 0.05)).alias("coast"))


@query("k18_class_lookup_unmapped", """
select o_orderpriority, coalesce(case o_orderpriority when '1-URGENT' then 'lgv' when '2-HIGH' then 'grande' end, 'autre') as class, count(*) as n,
 count(*) filter (where o_orderpriority not in ('1-URGENT','2-HIGH')) as unmapped from {orders} group by 1,2
""")
def _(v):
    names = {"1-URGENT": "lgv", "2-HIGH": "grande"}
    rows = v.orders.withColumn("class", K.class_lookup(F.col("o_orderpriority"), names, "autre"))
    return rows.groupBy("o_orderpriority", "class").agg(F.count("*").alias("n"), F.count_if(~F.col("o_orderpriority").isin(*names)).alias("unmapped"))


@query("k20_k21_names", """
select p_partkey, (p_name ilike '%lgv%' or p_size > 45) as fast, nullif(trim(split_part(p_name||' / other','/',1)),'') as first, upper(substr(p_name,1,1))||lower(substr(p_name,2)) as cap from {part}
""")
def _(v):
    packed = F.concat(F.col("p_name"), F.lit(" / other"))
    return v.part.select("p_partkey", K.is_highspeed(F.col("p_size") > 45, F.col("p_name")).alias("fast"), K.first_name(packed).alias("first"), K.capitalised(F.col("p_name")).alias("cap"))


@query("k22_moment_labels", """
select event_id, case when ts = date_trunc('day', ts) then strftime(ts, '%Y-%m-%d') else strftime(ts, '%Y-%m-%dT%H:%M:%S') end as label,
 strftime(date_trunc('day', ts), '%Y-%m-%d') as day from {events}
""")
def _(v):
    return v.events.select("event_id", K.moment_label(F.col("ts")).alias("label"), K.moment_label(F.date_trunc("day", "ts")).alias("day"))


@query("k23_k24_rounding", """
select l_orderkey, l_partkey, l_suppkey, l_extendedprice, round(l_extendedprice/7, 4) as declared, round_even(l_quantity/2e0, 0) as half_even from {lineitem}
""")
def _(v):
    return v.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", K.declared_number((F.col("l_extendedprice") / 7).cast("string")).alias("declared"), F.bround(F.col("l_quantity") / 2, 0).alias("half_even"))


@query("k25_folded_names", """
select doc_id, trim(regexp_replace(replace(replace(translate(lower(substr(text,1,60)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'),'œ','oe'),'æ','ae'), '[^a-z0-9]', ' ', 'g')) as folded from {documents}
""")
def _(v):
    return v.documents.select("doc_id", F.trim(K.folded_name(F.substring("text", 1, 60))).alias("folded"))


@query("k26_k27_k28_grid_keys", """
select code, case when n between 75101 and 75120 then '75056' when n between 69381 and 69389 then '69123' when n between 13201 and 13216 then '13055' else raw end as parent,
 0.5e0 + round_even((lon - 0.5e0) / 0.25e0, 0) * 0.25e0 as snap, 'N'||lpad(floor(lat)::int::varchar,2,'0')||'_'||case when lon >= 0 then 'E' else 'W' end||lpad(abs(floor(lon))::int::varchar,3,'0') as tile
from (select code, lon, lat, (75000 + population % 200)::int as n, (75000 + population % 200)::varchar as raw from {areas})
""")
def _(v):
    return v.areas.select("code", K.parent_code((75000 + F.col("population") % 200).cast("string")).alias("parent"), K.snapped(F.col("lon"), 0.25, 0.5).alias("snap"), K.tile_key(F.col("lon"), F.col("lat")).alias("tile"))


@query("k29_delta_coding", """
with o as (select l_orderkey, list(l_extendedprice order by l_extendedprice) as xs from {lineitem} group by 1)
select l_orderkey, len(xs)::int as n, round_even(xs[1]*100, 0)::bigint as first_unit, (round_even(xs[len(xs)]*100,0) - round_even(xs[1]*100,0))::bigint as span, round(xs[len(xs)], 2) as last_value from o
""")
def _(v):
    lists = v.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("xs"))
    coded = lists.select("l_orderkey", K.delta_encoded(F.col("xs"), 100.0).alias("d"))
    rest = F.aggregate(F.slice("d", F.lit(2), F.size("d")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return coded.select("l_orderkey", F.size("d").alias("n"), F.col("d")[0].alias("first_unit"), rest.alias("span"), F.round(F.element_at(K.delta_decoded(F.col("d"), 100.0), -1), 2).alias("last_value"))


@query("k30_labels", """
select p_partkey, case when p_size < 60 then p_size::varchar||' min' end as short, ((p_size*7)//60)::varchar||'h'||lpad(((p_size*7)%60)::varchar,2,'0') as long,
 case when p_size >= 7 then floor(p_size/7e0+0.5e0)::bigint::varchar||'/day' else p_size::varchar||'/week' end as freq,
 case when abs(r) < 0.1 then 'no linear relationship nationally' else (case when abs(r)<0.3 then 'a weak' when abs(r)<0.5 then 'a moderate' when abs(r)<0.7 then 'a strong' else 'a very strong' end)||' '||(case when r > 0 then 'positive' else 'negative' end)||' relationship nationally' end as words
from (select *, (p_size - 25) / 25e0 as r from {part} where p_size * 7 >= 60)
""")
def _(v):
    size = F.col("p_size")
    rows = v.part.where("p_size * 7 >= 60")
    return rows.select("p_partkey", K.duration_label(size).alias("short"), K.duration_label(size * 7).alias("long"), K.frequency_label(size).alias("freq"), K.strength_words((size - 25) / 25.0).alias("words"))


@query("f1_f2_key_and_box_filters", """
select case when substr(code,1,2) >= '97' then 'outside' else 'kept' end as reason, count(*) as n, count(*) filter (where lon between -5.4 and 9.8 and lat between 41.2 and 51.2) as in_box from (
 select lpad(((c_custkey * 977) % 100000)::varchar,5,'0') as code, -5e0 + (c_custkey*7919 % 14000)/1000e0 + (c_custkey % 4) as lon, 41.5e0 + (c_custkey*104729 % 9500)/1000e0 as lat from {customer}) group by 1
""")
def _(v):
    k = F.col("c_custkey")
    rows = v.customer.select(F.lpad(((k * 977) % 100000).cast("string"), 5, "0").alias("raw"), (F.lit(-5.0) + (k * 7919 % 14000) / 1000.0 + k % 4).alias("lon"), (F.lit(41.5) + (k * 104729 % 9500) / 1000.0).alias("lat"))
    kept = P.metropolitan(rows.select("raw").distinct(), F.col("raw")).select("raw", F.lit("kept").alias("reason"))
    told = rows.join(kept, "raw", "left").withColumn("reason", F.coalesce("reason", F.lit("outside")))
    return told.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(Q.in_metro(F.col("lon"), F.col("lat"))).alias("in_box"))


@query("f4_f6_f10_pinned_dimensions", """
select o_orderpriority, count(*) as n, round(sum(o_totalprice),2) as total from {orders} where o_orderstatus = 'O' and o_orderpriority not in ('5-LOW') group by 1
""")
def _(v):
    rows = dedup.pinned(v.orders, {"o_orderstatus": "O"}).where(~F.col("o_orderpriority").isin("5-LOW"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("f5_windows_of_years", """
select case when year <= 1999 then 'train' else 'test' end as part, count(*) as n, round(sum(ha),6) as ha from {fires} where year between 1995 and 2001 group by 1
""")
def _(v):
    rows = v.fires.where(F.col("year").between(1995, 2001))
    return rows.groupBy(F.when(F.col("year") <= 1999, "train").otherwise("test").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("ha"), 6).alias("ha"))


@query("f8_f9_published_pairs", """
select code, case when n_orders >= 8 then spend end as spend, avg_price, 100e0*n_orders/nullif(population,0) as rate from {area_stats} where spend is not null and avg_price is not null and population >= 30
""")
def _(v):
    both = v.area_stats.where("spend is not null and avg_price is not null and population >= 30")
    return both.select("code", K.published_if(F.col("spend"), F.col("n_orders"), 8).alias("spend"), "avg_price", K.rate(F.col("n_orders"), F.col("population")).alias("rate"))


@query("d1_keep_first_and_last", """
select code, max(case when a = 1 then valeur end) as first_value, max(case when b = 1 then valeur end) as last_value from (
 select code, valeur, row_number() over (partition by code order by annee, id_mutation, surface, type_local) as a, row_number() over (partition by code order by annee desc, id_mutation desc, surface desc, type_local desc) as b from {sale_rows}) group by 1
""")
def _(v):
    order = ["annee", "id_mutation", "surface", "type_local"]
    first = dedup.keep_first(v.sale_rows, ["code"], [F.col(c).asc() for c in order]).select("code", F.col("valeur").alias("first_value"))
    last = dedup.keep_first(v.sale_rows, ["code"], [F.col(c).desc() for c in order]).select("code", F.col("valeur").alias("last_value"))
    return first.join(last, "code")


@query("d2_d3_richest_and_heaviest", """
select categorie, x, y, max(poids) as poids, count(*) as doubles from (select categorie, round(lon,0)+0e0 as x, round(lat,0)+0e0 as y, poids from {venues}) group by 1,2,3
""")
def _(v):
    rows = v.venues.select("categorie", (F.round("lon", 0) + 0.0).alias("x"), (F.round("lat", 0) + 0.0).alias("y"), "poids")
    return dedup.keep_heaviest(rows, ["categorie", "x", "y"], "poids").select("categorie", "x", "y", "poids", "doubles")


@query("d2_keep_richest", """
select categorie, x, y, bool_or(p is not null) as rich, max(n) as doubles from (select *, count(*) over (partition by categorie, x, y) as n from (select categorie, round(lon,0)+0e0 as x, round(lat,0)+0e0 as y, case when venue_id % 4 = 0 then poids end as p from {venues})) group by 1,2,3
""")
def _(v):
    rows = v.venues.select("categorie", (F.round("lon", 0) + 0.0).alias("x"), (F.round("lat", 0) + 0.0).alias("y"), F.when(F.col("venue_id") % 4 == 0, F.col("poids")).alias("p"))
    doubles = rows.groupBy("categorie", "x", "y").agg(F.count("*").alias("doubles"))
    return dedup.keep_richest(rows, ["categorie", "x", "y"], "p").join(doubles, ["categorie", "x", "y"]).select("categorie", "x", "y", F.col("p").isNotNull().alias("rich"), "doubles")


@query("d5_highest_class", "select code, max(case type_local when 'A' then 1 when 'N' then 2 else 3 end) as class from {sale_rows} group by 1")
def _(v):
    level = F.when(F.col("type_local") == "A", 1).when(F.col("type_local") == "N", 2).otherwise(3)
    return v.sale_rows.groupBy("code").agg(F.max(level).alias("class"))
