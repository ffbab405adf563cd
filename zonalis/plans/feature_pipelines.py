"""Source pipelines that end in points, lines and polygons, and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions import keys as K
from zonalis.operators import dedup as D
from zonalis.operators import network as N
from zonalis.operators import spatial as S
from zonalis.operators.ranking import grouped_quantiles


def in_metro(lon: Column, lat: Column) -> Column:
    west, south, east, north = K.METRO_BOX
    return lon.between(west, east) & lat.between(south, north)


def venues(rows: DataFrame, visitors: DataFrame, kinds: Mapping[str, tuple[str, float | None]]) -> DataFrame:
    """P29. ``rows(id, kind, lon, lat, name)``, ``visitors(id, year, total)``, kind -> (category, weight or None for
    museums weighed by median visitors) -> one venue per category and place, the heaviest."""
    table = rows.sparkSession.createDataFrame([(k, c, w) for k, (c, w) in kinds.items()], "kind string, category string, fixed double")
    typical = grouped_quantiles(visitors.where("total > 0"), ["id"], "total", [0.5]).select("id", F.col("q")[0].alias("visitors"))
    joined = rows.join(F.broadcast(table), "kind").join(typical, "id", "left").where(in_metro(F.col("lon"), F.col("lat")))
    weighed = joined.withColumn("weight", F.bround(F.coalesce("fixed", K.museum_weight(F.col("visitors"))), 2))
    placed = weighed.select("category", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "name", "weight")
    return D.keep_heaviest(placed, ["category", "lon", "lat"], "weight").select("category", "lon", "lat", "name", "weight")


def festivals(rows: DataFrame) -> DataFrame:
    """P30. ``rows(name, reach, founded, lon, lat)`` -> festivals on the mainland with year and weight."""
    year = K.founding_year(F.col("founded"))
    kept = rows.where(in_metro(F.col("lon"), F.col("lat")))
    return kept.select(K.capitalised(F.trim("name")).alias("name"), year.alias("year"), K.reach_weight(F.col("reach"), year).alias("weight"), "lon", "lat")


def stop_service(calls: DataFrame, products: DataFrame) -> DataFrame:
    """Trains a day, stations reached without changing, services by frequency of each stop.

    ``calls(trip, product, pos, stop, minutes)`` of one week, optional flags; ``products(product, category, label)``.
    """
    for flag in ("no_pickup", "no_drop"):
        if flag not in calls.columns:
            calls = calls.withColumn(flag, F.lit(False))
    last = calls.groupBy("trip").agg(F.max("pos").alias("last"))
    c = calls.join(products, "product").join(last, "trip").withColumn("train", F.col("category") != "car")
    boards = c.where((F.col("pos") < F.col("last")) & (~F.col("no_pickup") | (F.col("pos") == 1)))
    labels = boards.groupBy("stop", "label").agg(F.count("*").alias("n"))
    named = labels.groupBy("stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))), lambda x: x["label"]), ", ").alias("services"))
    runs = boards.groupBy("stop").agg(F.bround(F.count_if("train") / 7.0, 1).alias("trains_day"))
    later = c.where(~F.col("no_drop") | (F.col("pos") == F.col("last"))).select("trip", F.col("stop").alias("to"), F.col("pos").alias("to_pos"))
    reach = boards.where("train").select("trip", "stop", "pos").join(later, "trip").where("to_pos > pos and to <> stop").select("stop", "to").distinct().groupBy("stop").agg(F.count("*").alias("destinations"))
    return runs.join(named, "stop").join(reach, "stop", "left").fillna({"destinations": 0})


def stations(rows: DataFrame, footfall: DataFrame, service: DataFrame) -> DataFrame:
    """P31. ``rows(name, uic, code, segment, lon, lat)``, ``footfall(uic, now, before)``, ``service`` of stop_service()."""
    f = footfall.select(K.uic8(F.col("uic")).alias("uic"), "now", "before")
    s = service.select(K.uic8(F.col("stop").cast("string")).alias("uic"), "trains_day", "destinations", "services")
    r = rows.select("name", K.uic8(F.col("uic")).alias("uic"), K.normalise_code(F.col("code")).alias("code"), K.best_grade(F.col("segment")).alias("segment"), "lon", "lat").where(in_metro(F.col("lon"), F.col("lat")))
    out = r.join(f, "uic", "left").join(s, "uic", "left")
    return out.withColumn("trend", F.bround(F.try_divide(100.0 * (F.col("now") - F.col("before")), F.col("before")), 1))


def rail_network(calls: DataFrame, lines: DataFrame, stops: DataFrame, speeds: DataFrame, fast: str, car: str, junction: float = 60.0, station: float = 500.0, extra: float = 150.0, penalty: float = 4.0) -> DataFrame:
    """P32. Hops between consecutive stops with their way along the track or the reason for none.

    ``calls`` as in N.rides, ``lines``, ``stops`` and ``speeds`` as in N.track_graph, in metres. Coaches (``car``) are
    left out; only trips of product ``fast`` take high-speed track without a penalty.
    """
    edges, at = N.track_graph(lines, stops, speeds, junction, station, extra)
    return N.routed_hops(edges, calls, at.join(stops.withColumnRenamed("pid", "stop"), "stop"), fast, car, penalty)


def rail_lines(features: DataFrame, speeds: DataFrame, status: DataFrame, classes: Mapping[str, str]) -> DataFrame:
    """P33. ``features(line, rank, category, pkd, points)`` with points in metres, ``speeds(line, kmh)``,
    ``status(line, state)`` -> one row per piece: class, top speed, in service, km."""
    length = G.line_length(F.col("points"))
    ends = features.withColumns({"length": F.round(length, 1), "a": F.col("points")[0], "b": F.element_at("points", -1)})
    one = D.keep_richest(ends, ["line", "rank", "a", "b", "length"], "pkd")
    top = speeds.groupBy("line").agg(F.max("kmh").alias("kmh"))
    live = status.groupBy("line").agg(F.bool_or(F.col("state") == "Exploitée").alias("live"))
    out = one.join(top, "line", "left").join(live, "line", "left")
    return out.select("line", "rank", K.class_lookup(F.col("category"), classes, "autre").alias("class"), "kmh", "live", F.bround(F.col("length") / 1000, 2).alias("km"), "points")


def waters(rivers: DataFrame, lakes: DataFrame, natures: Mapping[str, str], tiers: Sequence[tuple[float, int]], navigable_zoom: int = 6) -> tuple[DataFrame, DataFrame]:
    """P34. ``rivers(id, name, nature, width_zoom, navigable, points)``, ``lakes(id, name, nature, rings)`` in metres
    -> named rivers with length and zoom, lakes with area and zoom. A nature outside the table is an error."""
    unknown = lakes.where(~F.coalesce(F.col("nature").isin(*natures), F.lit(False))).limit(1).collect()
    if unknown:
        raise ValueError(f"no class for {unknown[0]['nature']}")
    km2 = G.polygon_area(F.col("rings")) / 1e6
    lake = D.keep_first(lakes, ["id"], [F.col("name").asc_nulls_last()])
    lake = lake.select("id", K.first_name(F.col("name")).alias("name"), K.class_lookup(F.col("nature"), natures).alias("class"), F.bround(km2, 2).alias("km2"), K.floor_tier(km2, tiers).alias("zoom"))
    zoom = F.when(F.col("navigable"), F.least("width_zoom", F.lit(navigable_zoom))).otherwise(F.col("width_zoom"))
    river = D.keep_first(rivers, ["id"], [F.col("name").asc_nulls_last()])
    river = river.select("id", K.first_name(F.col("name")).alias("name"), F.bround(G.line_length(F.col("points")) / 1000, 2).alias("km"), zoom.alias("zoom"))
    return river, lake


def rail_projects(lines: DataFrame, country: DataFrame, modes: Mapping[str, str], size: float) -> DataFrame:
    """P35. ``lines(line_id, name, mode, highspeed, line)`` that meet ``country(poly, rings)``."""
    kept = S.lines_meeting_polygons(lines, country, size)
    return kept.select("line_id", "name", K.class_lookup(F.col("mode"), modes, "train").alias("mode"), K.is_highspeed(F.col("highspeed"), F.col("name")).alias("highspeed"), F.bround(G.line_length(F.col("line")) / 1000, 2).alias("km"))


def parks(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """P36. ``features(id_local, name, kind, placeholder, rings)`` -> kind, hectares; placeholders and far ones go."""
    local = F.upper(F.coalesce("id_local", F.lit("")))
    national = F.when(local.startswith("AA_"), "Parc national — aire d'adhésion").otherwise("Parc national — cœur")
    kept = features.where(~F.coalesce("placeholder", F.lit(False)) & G.boxes_overlap(G.bounds(F.col("rings")), *box))
    return kept.select("name", F.when(F.col("kind") == "Parc national", national).otherwise(F.col("kind")).alias("kind"), F.bround(G.polygon_area(F.col("rings")) / 1e4, 0).alias("ha"))


def aerodromes(features: DataFrame, noise_plans: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """P37. ``features(icao, name, category, fictive, rings)``, ``noise_plans(icao)`` -> hectares, label point, flag."""
    plans = noise_plans.select(F.upper(F.trim("icao")).alias("icao"), F.lit(True).alias("noise_plan")).distinct()
    kept = features.where(~F.coalesce("fictive", F.lit(False))).withColumn("icao", F.upper(F.trim("icao"))).join(plans, "icao", "left")
    p = G.interior_point(F.col("rings"))
    return kept.select("icao", "name", K.class_lookup(F.col("category"), categories, "autre").alias("category"), F.coalesce("noise_plan", F.lit(False)).alias("noise_plan"), F.bround(G.polygon_area(F.col("rings")) / 1e4, 1).alias("ha"), p.alias("label"))


def piezometers(records: DataFrame, since: str) -> DataFrame:
    """P38. ``records(code_bss, date_fin_mesure, x, y)`` still measuring on or after ``since`` (ISO text)."""
    one = D.keep_first(records, ["code_bss"], [F.col("date_fin_mesure").desc_nulls_last()])
    return one.where((F.col("date_fin_mesure") >= since) & in_metro(F.col("x"), F.col("y")))


def field_catalogue(fields: DataFrame) -> DataFrame:
    """P39. ``fields(field, source, source_order, type, choropleth, correlate, label)`` -> numeric map fields that take
    part, the first declaration of each, with short labels."""
    kept = fields.where((F.col("type") == "numeric") & F.col("choropleth") & F.coalesce(F.col("correlate"), F.lit(True)))
    return D.keep_first(kept, ["field"], [F.col("source_order"), F.col("source")]).select("field", "source", K.short_label(F.col("label")).alias("label"))


def inspect(point: tuple[float, float], areas: DataFrame, table: DataFrame, fields: DataFrame, places: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """P40. The area that holds a point, the smallest code of several, with every declared field as a row, and the nearest place.

    ``areas(code, rings)``, ``table(code, ...)``, ``fields(field, source, label)``, ``places(site, sx, sy)``.
    """
    x, y = point
    b = G.bounds(F.col("rings"))
    hit = areas.where((b["min_x"] <= x) & (b["max_x"] >= x) & (b["min_y"] <= y) & (b["max_y"] >= y)).where(G.in_polygon(F.lit(x), F.lit(y), F.col("rings"))).agg(F.min("code").alias("code"))
    values = [c for c in table.columns if c != "code"]
    row = table.join(hit, "code").select("code", *[F.col(c).cast("string").alias(c) for c in values])
    long = row.unpivot("code", values, "field", "value").join(fields, "field").orderBy("source", "field")
    d = F.hypot(F.col("sx") - x, F.col("sy") - y)
    near = places.agg(F.min(F.struct(d.alias("distance"), "site")).alias("m")).select("m.site", "m.distance")
    return long, near

