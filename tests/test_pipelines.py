"""Pipelines on literal frames of their input schemas."""

import pytest
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.plans import area_pipelines as P
from zonalis.plans import feature_pipelines as Q


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def areas(spark):
    base = spark.createDataFrame([("01001", 0.0, 0.0), ("01002", 1.0, 0.0)], "code string, x0 double, y0 double")
    return base.select("code", G.square(F.col("x0"), F.col("y0"), 1.0).alias("rings"))


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_base_areas(spark):
    f = spark.createDataFrame([("1001", "A", "01", "84", "Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]"), ("97101", "B", "971", "01", "Polygon", "[]")], "code_insee string, nom string, dep string, reg string, geom_type string, coordinates string")
    assert rows(P.base_areas(f), "code", "name") == [("01001", "A")]


def test_income_keeps_suppressed_values_blank(spark):
    m = spark.createDataFrame([("1001", "21000", "s"), ("1002", "ND", "12,5")], "code string, median string, poverty string")
    d = spark.createDataFrame([("1001", "10000", "30000", "0,2749")], "code string, d1 string, d9 string, gini string")
    assert rows(P.income(m, d), "code", "median", "poverty", "decile_ratio", "gini") == [("01001", 21000.0, None, 3.0, 0.275), ("01002", None, 12.5, None, None)]


def test_employment(spark):
    cells = {"Y15T64": {"_T": 100.0, "1": 70.0, "1T2": 80.0, "2": 10.0}, "Y_GE15": {"_T": 150.0, "31": 30.0, "33": 15.0}}
    r = spark.createDataFrame([("01001", a, s, x) for a, d in cells.items() for s, x in d.items()], "code string, age string, status string, value double")
    f = spark.createDataFrame([("01001", "_T", "_T", 75.0), ("01001", "_T", "1", 15.0), ("01001", "_T", "2", 60.0), ("01001", "_T", "22T27", 6.0), ("01001", "PT", "_T", 20.0)], "code string, time string, form string, value double")
    j = spark.createDataFrame([("01001", 50.0), ("01002", 7.0)], "code string, jobs double")
    out = {r["code"]: r for r in P.employment(r, f, j).collect()}
    assert (out["01001"]["employment"], out["01001"]["unemployment"], out["01001"]["precarious"], out["01001"]["concentration"]) == (70.0, 12.5, 10.0, 67.0)
    assert out["01002"]["employment"] is None and out["01002"]["jobs"] == 7.0
    with pytest.raises(ValueError, match="duplicate"):
        P.employment(r.unionByName(r), f, j)


def test_sectors(spark):
    w = spark.createDataFrame([("a", "agri", 150.0, False), ("a", "serv", 100.0, False), ("b", "agri", 10.0, False), ("b", "serv", 990.0, True)], "code string, sector string, value double, masked boolean")
    out = {r["code"]: r for r in P.sectors(w, {"agri": ["agri"], "serv": ["serv"]}, {"agri": "Farming", "serv": "Services"}).collect()}
    # b's masked group counts for nothing in the whole, so services stand out in a
    assert out["a"]["distinctive"] == "Services" and out["a"]["share_agri"] == 60.0 and out["b"]["share_serv"] is None


def test_beds(spark):
    base = spark.createDataFrame([("a", 10), ("b", 5)], "code string, population int")
    c = spark.createDataFrame([("a", 4, 2, 3, 2)], "code string, rooms int, beds int, pitches int, annual int")
    h = spark.createDataFrame([("a", 3, 12)], "code string, second_homes int, dwellings int")
    beds = P.tourist_beds(base, c, h)
    assert rows(beds) == [("a", 34, 3.4, 13, 21, 38.24, 4, 3, 2, 2, 3, 25.0), ("b", 0, 0.0, 0, 0, None, 0, 0, 0, 0, None, None)]
    assert rows(P.seasonal_bed_share(beds, {"pitches": True})) == [("a", 23.1), ("b", None)]
    with pytest.raises(ValueError, match="parts"):
        P.seasonal_bed_share(beds.withColumn("bookable", F.col("bookable") + 5), {})
    with pytest.raises(ValueError, match="no kind"):
        P.seasonal_bed_share(beds, {"tents": True})


def test_registers(spark):
    notices = spark.createDataFrame([("1001", "Inondations", "2001-02-03"), ("1001", "Inondations", "1999-01-01"), ("1002", "Feux", "2003-01-01")], "code string, label string, start string")
    dossiers = spark.createDataFrame([("1001", "11"), ("1003", " 12 "), ("1003", "13")], "code string, number string")
    plans = spark.createDataFrame([("1001", "Prescrit", "", "Inondation", None), ("1001", "Opposable", "", "Feu", "Recul"), ("1004", "Caduque", "", "Inondation", "x"), ("1005", "Opposable", "", "Feu", "x")], "code string, stage string, detail string, family string, label string")
    atlas = spark.createDataFrame([("1006",)], "code string")
    out = P.risk_registers(notices, dossiers, plans, atlas, ["Inondations"], {"flood": "11", "submersion": "12", "retreat": "13"}, "Inondation", ["Recul"])
    assert rows(out) == [
        ("01001", 2, 2001, "prescrit", "non", "oui", "aucun", "approuve"), ("01003", 0, None, "aucun", "non", "non", "les_deux", "aucun"),
        ("01004", 0, None, "caduque", "non", "non", "aucun", "aucun"), ("01006", 0, None, "aucun", "oui", "non", "aucun", "aucun"),
    ]


def test_indicator_files(spark):
    data = [("1001", "27", "median", "-12.34", "I", "oui"), ("1001", "40", "median", "-20.06", "I", "oui"), ("1001", "27", "p10", "9", "J", "oui")]
    f = spark.createDataFrame(data, "code_territoire string, rechauffement_france string, statistique string, resultat string, code_indicateur string, donnees_issues_territoire string")
    assert rows(P.flood_peaks(f, ["27", "40"], "I")) == [("01001", "oui", -12.3, -20.1)]
    assert rows(P.low_flows(f, f, ["27"], ("I", "I"))) == [("01001", "oui", -12.3, -12.3)]
    with pytest.raises(ValueError, match="also holds"):
        P.flood_peaks(f.withColumn("statistique", F.lit("median")), ["27"], "I")


def test_population_weighted_grids(spark):
    cells = spark.createDataFrame([("c1", 0.25, 0.25, 3.0), ("c2", 0.75, 0.25, 1.0), ("c3", 9.0, 9.0, 5.0)], "cell string, x double, y double, pop double")
    grid = spark.createDataFrame([(1, 0.25, 0.2, 10.0), (2, 0.75, 0.2, 20.0), (3, 1.5, 0.5, 30.0)], "point bigint, x double, y double, hot double")
    assert rows(P.projected_heat(areas(spark), cells, grid, ["hot"], 1.0)) == [("01001", 12.5, "population"), ("01002", 30.0, "point")]
    grids = spark.createDataFrame([(y, 0, c, v) for y in (1, 2) for c, v in ((0, 4.0), (1, 8.0))] + [(1, 0, 2, 5.0)], "year int, row bigint, col bigint, value double")
    assert rows(P.air_quality(areas(spark), cells, grids, (0.0, 0.0), 0.5, 1.0)) == [("01001", 5.0, 5.0, 5.0, 8.0, "population"), ("01002", 5.0, 5.0, 5.0, None, "surface")]
    assert P.air_cells(grids, (0.0, 0.0), 0.5).count() == 2
    zone = spark.createDataFrame([("z", 0.5, 0.0, 3)], "poly string, x0 double, y0 double, class int").select("poly", G.square(F.col("x0"), F.col("y0"), 0.5).alias("rings"), "class")
    assert rows(P.clay(areas(spark), cells, zone, 1.0)) == [("01001", 25.0, 0.75), ("01002", None, None)]


def test_climate(spark):
    days = [(p, f"{y}-{m:02d}-{d:02d}", y, m, 10.0 * m + d + p, 1.0 * m - d, 5.0 * m, 2.0 if d == 1 else 0.5, 60.0, 360.0) for p in (1, 2, 3) for y in (2020, 2021) for m in range(1, 13) for d in (1, 2)]
    daily = spark.createDataFrame(days, "point int, day string, year int, month int, tx double, tn double, t double, precip double, hu double, ssi double")
    monthly = P.month_summaries(daily)
    # Stations read 1 - 5 dz above the grid in everything, and see nine tenths of the rainy days.
    stations = spark.createDataFrame([(f"s{p}", p, 0.1 * p) for p in (1, 2, 3)], "post string, point int, dz double")
    off = 1 - 5 * F.col("dz")
    obs = monthly.where("month <= 12").join(stations, "point").select("post", "year", "month", *[(F.col(c) + off).alias(c) for c in P.CORRECTED], (F.col("rainy") * 0.9).alias("rainy"))
    pairs = spark.createDataFrame([("a", 1, 5.0, 0.2), ("a", 2, 15.0, 0.2)], "code string, point int, weight double, dz double")
    table = {r["month"]: r for r in P.climate(daily, obs, stations, pairs, least_years=2).collect()}
    assert len(table) == 13 and table[1].asDict() == {
        "code": "a", "month": 1, "record_high": 13.8, "mean_max": 13.8, "tx": 13.2, "tm": 5.0, "tn": -0.5, "mean_min": -1.0, "record_low": -1.0, "precip": 2.5, "rainy": 0.9, "snow": 1.0, "hu": 60.0, "solar": 2.0,
    }
    assert (table[3]["snow"], table[13]["snow"]) == (0.0, 1.0) and table[13]["precip"] == 30.0 and table[13]["solar"] == 24.0
    assert (table[13]["record_high"], table[13]["mean_max"], table[13]["mean_min"], table[13]["tm"]) == (123.8, 123.8, -1.0, 32.5)
    fits, _ = P.calibration(P.station_errors(monthly, obs, stations, 2))
    assert {(r["key"], r["month"]) for r in fits.collect()} == {(k, m) for k in P.CORRECTED for m in range(1, 13)} | {("tx_max", 13), ("tn_min", 13)}
    noisy = obs.withColumn("hu", F.col("hu") + F.when(F.col("post") == "s2", 50.0).otherwise(0.0))
    with pytest.raises(ValueError, match="beyond their limits"):
        P.climate(daily, noisy, stations, pairs, least_years=2, limits={"hu": 3.0})


def test_wind_days_need_every_year(spark):
    rows_ = [(1, 0.0, 0.0, y, 7, w) for y in (2020, 2021) for w in (4.0, 6.0, 7.0)]
    daily = spark.createDataFrame(rows_ + [(1, 0.0, 0.0, 2020, 1, 9.0)], "point int, x double, y double, year int, month int, wind double")
    assert rows(P.wind_days(daily, [6, 7], 5.0), "point", "days") == [(1, 2.0)]
    with pytest.raises(ValueError, match="lacks"):
        P.wind_days(daily.unionByName(daily.withColumn("point", F.lit(2)).where("year = 2020")), [6, 7], 5.0)


def test_festivals_and_stations(spark):
    f = spark.createDataFrame([(" jazz d'été", "Internationale", "1985", 2.0, 48.0), ("x", None, "vers 2015", -60.0, 5.0)], "name string, reach string, founded string, lon double, lat double")
    assert rows(Q.festivals(f), "year", "weight") == [(1985, 4.5)]
    s = spark.createDataFrame([("Gare", "391003", "1001", "C;A", 2.0, 48.0)], "name string, uic string, code string, segment string, lon double, lat double")
    foot = spark.createDataFrame([("00391003", 150, 100)], "uic string, now bigint, before bigint")
    service = spark.createDataFrame([("00391003", 4.0, 7, "TER")], "stop string, trains_day double, destinations bigint, services string")
    r = Q.stations(s, foot, service).first()
    assert (r["segment"], r["trend"], r["trains_day"], r["code"]) == ("A", 50.0, 4.0, "01001")


def test_rail(spark):
    lines = spark.createDataFrame([("l1", 1, "LGV", None), ("l1", 1, "LGV", "5+3")], "line string, rank int, category string, pkd string").withColumn("points", points((0, 0), (3000, 4000)))
    speeds = spark.createDataFrame([("l1", 300), ("l1", 160)], "line string, kmh int")
    status = spark.createDataFrame([("l1", "Exploitée")], "line string, state string")
    assert rows(Q.rail_lines(lines, speeds, status, {"LGV": "lgv"}), "line", "class", "kmh", "live", "km") == [("l1", "lgv", 300, True, 5.0)]
    track = spark.createDataFrame([("m", 0.0, 0.0, 10_000.0, 0.0, 0.0, False), ("n", 10_000.0, 30.0, 10_000.0, 5000.0, 0.0, False), ("g", 0.0, 120.0, 10_000.0, 120.0, 0.0, True)], "lid string, x0 double, y0 double, x1 double, y1 double, s0 double, lgv boolean")
    calls = spark.createDataFrame([(1, "ter", 1, 10), (1, "ter", 2, 20), (1, "ter", 3, 40), (2, "bus", 1, 10), (2, "bus", 2, 30)], "trip int, product string, pos int, stop int")
    stops = spark.createDataFrame([(10, 0.3, 0.0), (20, 10_000.0, 4000.0), (40, 90_000.0, 0.0)], "pid int, x double, y double")
    out = Q.rail_network(calls, track, stops, spark.createDataFrame([("m", 100.0, False), ("n", 100.0, False)], "lid string, kmh double, lgv boolean"), "tgv", "bus")
    # The stop 0.3 m from the line's end stays on the network; line n's end 30 m off joins line m.
    got = {(r["a"], r["b"]): r for r in out.collect()}
    assert set(got) == {(10, 20), (20, 40)} and got[20, 40]["outcome"] == "stop off the network"
    assert got[10, 20]["outcome"] == "routed" and abs(got[10, 20]["metres"] - (10_000 - 0.3 + 3970)) < 0.5


def test_waters_parks_and_aerodromes(spark):
    rivers = spark.createDataFrame([("r", "Loire/Leyre", 8, True), ("r", None, 8, True)], "id string, name string, width_zoom int, navigable boolean").withColumn("nature", F.lit("x")).withColumn("points", points((0, 0), (0, 2500)))
    lakes = spark.createDataFrame([("k", "Lac", "Lac")], "id string, name string, nature string").withColumn("rings", F.array(points((0, 0), (2000, 0), (2000, 1000), (0, 1000), (0, 0))))
    river, lake = Q.waters(rivers, lakes, {"Lac": "lac"}, [(5, 6), (1, 8)])
    assert rows(river) == [("r", "Loire", 2.5, 6)] and rows(lake) == [("k", "Lac", "lac", 2.0, 8)]
    with pytest.raises(ValueError, match="no class"):
        Q.waters(rivers, lakes, {}, [(1, 8)])
    park = lakes.select(F.lit("aa_1").alias("id_local"), "name", F.lit("Parc national").alias("kind"), F.lit(None).cast("boolean").alias("placeholder"), "rings")
    assert rows(Q.parks(park, (0, 0, 9, 9))) == [("Lac", "Parc national — aire d'adhésion", 200.0)]
    field = lakes.select(F.lit(" lfpg").alias("icao"), "name", F.lit("A").alias("category"), F.lit(False).alias("fictive"), "rings")
    noise = spark.createDataFrame([("LFPG",)], "icao string")
    assert rows(Q.aerodromes(field, noise, {"A": "grand"}), "icao", "category", "noise_plan", "ha") == [("LFPG", "grand", True, 200.0)]


def test_projects_and_piezometers(spark):
    lines = spark.createDataFrame([("in", "Ligne nouvelle X", "tram"), ("out", "Y", "tram")], "line_id string, name string, mode string").withColumn("line", F.when(F.col("line_id") == "in", points((-1, 0.5), (3, 0.5))).otherwise(points((5, 5), (6, 6)))).withColumn("highspeed", F.lit(None).cast("boolean"))
    country = areas(spark).withColumnRenamed("code", "poly")
    assert rows(Q.rail_projects(lines, country, {"tram": "tramway"}, 1.0), "line_id", "mode", "highspeed") == [("in", "tramway", True)]
    p = spark.createDataFrame([("b1", "2023-05-01", 2.0, 48.0), ("b1", "2019-01-01", 2.0, 48.0), ("b2", None, 2.0, 48.0)], "code_bss string, date_fin_mesure string, x double, y double")
    assert rows(Q.piezometers(p, "2022-01-01"), "code_bss") == [("b1",)]


def test_station_errors_join_months_not_keys(spark):
    """The keys of a month stay side by side in the join; a pair counts where both sides have a value."""
    keys = (*P.CORRECTED, "rainy")
    kinds = ", ".join(f"{k} double" for k in keys)
    value = lambda year, add: [None if year == 2 and add else float(i + year + add) for i in range(len(keys))]
    monthly = spark.createDataFrame([(1, y, 5, *value(y, 0)) for y in (1, 2, 3)], f"point int, year int, month int, {kinds}")
    obs = spark.createDataFrame([(7, y, 5, *value(y, 1)) for y in (1, 2, 3)], f"post int, year int, month int, {kinds}")
    stations = spark.createDataFrame([(7, 1, 0.5)], "post int, point int, dz double")
    seen = []
    keep = P.cut
    P.cut = lambda df: (seen.append(df.count()), keep(df))[1]
    try:
        out = P.station_errors(monthly, obs, stations, 2)
    finally:
        P.cut = keep
    assert seen == [1], "one row a station and month travels, not one a key"
    assert {r["key"]: (r["month"], r["post"], r["dz"], r["obs"], r["grid"]) for r in out.collect()} == {k: (5, 7, 0.5, i + 3.0, i + 2.0) for i, k in enumerate(keys)}
    assert P.station_errors(monthly, obs, stations, 3).count() == 0
