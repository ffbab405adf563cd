"""Models against numpy fits, graphs against plain searches."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import models as M
from zonalis.operators import network as N
from zonalis.operators import spatial as S
from zonalis.operators.graph_components import connected_components
from zonalis.operators.stats import local_correlation
from zonalis.operators.thinning import keep_mask, thinned


def test_poisson_fit(spark):
    rng = np.random.default_rng(3)
    x, exposure = rng.normal(size=(400, 2)), rng.uniform(1, 5, 400)
    y = rng.poisson(np.exp(0.3 + x @ [0.5, -0.4]) * exposure)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, exposure)], "a double, b double, y double, e double")
    got = M.fit_poisson(df, ["a", "b"], "y", "e", 2.0)
    terms, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(50):
        mu = np.exp(terms @ beta) * exposure
        gradient = terms.T @ (y - mu) - np.array([0, 2, 2]) * beta
        beta = beta + np.linalg.solve((terms.T * mu) @ terms + np.diag([0, 2, 2]), gradient)
    assert np.abs(got - beta).max() < 1e-7
    predicted = M.with_prediction(df, ["a", "b"], got, "e")
    mu = np.exp(terms @ beta) * exposure
    assert abs(M.dispersion(predicted, "y", 3).first()[0] - ((y - mu) ** 2 / mu).sum() / 397) < 1e-6


def test_cross_validated_line(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, 200)
    y = 2 + 3 * x + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    fits, rows = M.cross_validated_line(df, [], "x", "y", F.pmod("i", F.lit(10)))
    errors = np.empty(200)
    for k in range(10):
        test = np.arange(200) % 10 == k
        b, a = np.polyfit(x[~test], y[~test], 1)
        errors[test] = y[test] - (a + b * x[test])
    row = fits.first()
    assert abs(row["rmse"] - np.sqrt((errors**2).mean())) < 1e-9 and abs(row["b"] - np.polyfit(x, y, 1)[0]) < 1e-9
    assert rows.count() == 200


def test_quickest_ways(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b), i, float(s), bool(i % 4 == 0), 10.0) for i, (a, b, s) in enumerate(zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.uniform(1, 9, 60))) if a != b]
    df = spark.createDataFrame(edges, "src int, dst int, piece int, seconds double, lgv boolean, length double")
    got = {(r["source"], r["node"]): r for r in N.quickest(df, spark.createDataFrame([(0,), (7,)], "source int"), 4.0).collect()}
    for source in (0, 7):
        best, heap = {source: 0.0}, [(0.0, source)]
        while heap:
            cost, node = heapq.heappop(heap)
            if cost > best[node]:
                continue
            for a, b, _, s, lgv, _ in edges:
                for u, w in ((a, b), (b, a)):
                    c = cost + s * (4 if lgv else 1)
                    if u == node and c < best.get(w, 1e9):
                        best[w] = c
                        heapq.heappush(heap, (c, w))
        assert {n for s, n in got if s == source} == set(best)
        assert all(abs(got[source, n]["cost"] - c) < 1e-9 for n, c in best.items())
        assert all(got[source, n]["metres"] == 10.0 * len(got[source, n]["path"]) for n in best)


def test_large_networks_are_searched_like_small_ones(spark):
    """Chains between few crossings, a ring without any, a part of its own, parallel and looping pieces."""
    rng = np.random.default_rng(1)
    edges, node = [], 1000
    for i in range(30):
        a, b = (int(x) for x in rng.integers(0, 12, 2))
        for _ in range(int(rng.integers(0, 6))):
            edges.append((a, node, float(rng.integers(1, 5)), bool(rng.random() < 0.4)))
            a, node = node, node + 1
        edges.append((a, b, float(rng.integers(1, 5)), bool(rng.random() < 0.4)))
    edges += [(500, 501, 1.0, False), (501, 502, 1.0, False), (502, 500, 1.0, False), (600, 601, 2.0, True), (601, 602, 2.0, False)]
    df = spark.createDataFrame([(a, b, i, s, lgv, 7.0 + i) for i, (a, b, s, lgv) in enumerate(edges)], "src int, dst int, piece int, seconds double, lgv boolean, length double")
    asked = spark.createDataFrame([(0, 1.0, 5), (0, 1.0, 7), (0, 4.0, 11), (3, 4.0, 3), (3, 4.0, 602), (600, 1.0, 602), (9, 4.0, 2), (9, 4.0, 1003)], "source int, penalty double, node int")
    rows = lambda **how: {(r["source"], r["penalty"], r["node"]): (r["cost"], r["metres"], r["path"]) for r in N.quickest(df, asked.select("source", "penalty").distinct(), **how).collect()}
    small, large = rows(wanted=asked), rows(wanted=asked, most=0)
    assert small == large and {(0, 1.0, 5), (3, 4.0, 3), (600, 1.0, 602)} <= set(small) and (3, 4.0, 602) not in small
    every, spread = rows(), rows(most=0)
    assert every == spread and all(every[k] == v for k, v in small.items())
    lengths = {i: 7.0 + i for i in range(len(edges))}
    assert all(abs(m - sum(lengths[p] for p in path)) < 1e-9 for _, m, path in every.values())


def test_contracted_chains_hold_every_piece_in_order(spark):
    from zonalis.operators.routing import contracted

    edges = [(i, i + 1, 100 + i, 1.0, i % 3 == 0, 2.0) for i in range(70)] + [(0, 200, 300, 1.0, False, 1.0), (70, 201, 301, 1.0, False, 1.0), (0, 202, 302, 1.0, False, 1.0)]
    df = spark.createDataFrame(edges, "src int, dst int, piece int, seconds double, lgv boolean, length double")
    shortcuts, parts = contracted(df, spark.createDataFrame([(40,)], "node int"))
    ways = {(r["src"], r["dst"]): r for r in shortcuts.collect()}
    assert (0, 40) in ways and (40, 0) in ways and ways[0, 40]["k"] == 40 and ways[40, 201]["k"] == 31
    assert ways[0, 40]["plain"] + ways[0, 40]["fast"] == 40.0 and ways[0, 40]["fast"] == 14.0
    pieces = [r["piece"] for r in parts.where(F.col("chain") == ways[40, 0]["chain"]).orderBy("at").collect()]
    assert pieces == [100 + i for i in range(39, -1, -1)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (None, 3), (9, 9)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert connected_components(edges.where("src > 1000")).count() == 0


def test_call_order_follows_every_trip(spark):
    trips = {1: [7, 1, 2, 3], 2: [7, 2, 3], 3: [7, 1, 3], 4: [5, 7, 4, 3]}
    rows = [(t, "x", i + 1, s, 10 * i) for t, stops in trips.items() for i, s in enumerate(stops)]
    calls = spark.createDataFrame(rows, "trip int, product string, pos int, stop int, minutes int")
    out = N.call_orders(N.rides(calls, 7), 7).orderBy("place").collect()
    assert [r["stop"] for r in out][-1] == 3 and [r["every_run"] for r in out] == [False, False, False, True]
    order = [r["stop"] for r in out]
    assert order.index(1) < order.index(2) < order.index(3)
    flagged = calls.withColumns({"no_pickup": (F.col("trip") == 4) & (F.col("pos") == 2), "no_drop": (F.col("stop") == 2)})
    reached = {r["stop"]: r["runs"] for r in N.destinations(N.rides(flagged, 7), 7).collect()}
    assert reached == {1: 2, 3: 3}


def test_nearest_far_apart(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1000.0, 1000.0)], "id string, x double, y double")
    sites = spark.createDataFrame([(1, 3.0, 4.0), (2, -500.0, 0.0)], "site bigint, sx double, sy double")
    got = {r["id"]: (r["site"], round(r["distance"], 3)) for r in S.nearest(points, sites, 0.5).collect()}
    assert got == {"a": (1, 5.0), "b": (1, round(float(np.hypot(997, 996)), 3))}
    assert S.nearest(points, sites.where("site > 5"), 0.5).where("site is null").count() == 2


def test_local_correlation_gives_up_on_few(spark):
    df = spark.createDataFrame([(str(i), 2.0 + i * 0.001, 48.0, float(i), float(i * i)) for i in range(5)], "code string, lon double, lat double, a double, b double")
    assert [r["r"] for r in local_correlation(df, "a", "b").collect()] == [None] * 5
    assert all(r["r"] > 0.9 for r in local_correlation(df, "a", "b", least=3).collect())


def brute_local(rows, radius, least=12, rings=3):
    from zonalis.functions.geometry import KM_PER_DEG_LAT, KM_PER_DEG_LON

    lon, lat, x, y = (np.array(c) for c in zip(*[r[1:] for r in rows]))
    out = {}
    for i, (code, *_) in enumerate(rows):
        d2 = ((lon - lon[i]) * (KM_PER_DEG_LON * np.cos(np.radians(lat[i])))) ** 2 + ((lat - lat[i]) * KM_PER_DEG_LAT) ** 2
        out[code] = (None, None, None)
        for k in range(1, rings + 1):
            at = d2 <= (radius * k) ** 2
            if at.sum() >= least:
                flat = min(x[at].var(), y[at].var()) * at.sum() <= 1e-12
                out[code] = (None if flat else np.corrcoef(x[at], y[at])[0, 1], int(at.sum()), radius * k)
                break
    return out


@pytest.mark.parametrize("crowded", [4, 1000])
def test_local_correlation_of_dense_and_lone_rows(spark, crowded):
    """A dense town, many rows of one place, a thin country and far outliers; cells add up as their rows do."""
    rng = np.random.default_rng(12)
    at = [(2 + rng.normal() * 0.02, 48 + rng.normal() * 0.02) for _ in range(150)] + [(2.5, 48.2)] * 40 + [(rng.uniform(0, 6), rng.uniform(44, 50)) for _ in range(120)] + [(9.0, 42.0), (9.1, 42.0)]
    rows = [(f"c{i}", float(a), float(b), 1e6 + float(rng.normal()), float(rng.normal() + a)) for i, (a, b) in enumerate(at)]
    lost = [("nan", float("nan"), 48.0, 1.0, 1.0), ("null", None, 48.0, 1.0, 1.0), ("no value", 2.0, 48.0, float("nan"), 1.0)]
    df = spark.createDataFrame([*rows, *lost], "code string, lon double, lat double, p double, q double")
    got = {r["code"]: (r["r"], r["n"], r["radius"]) for r in local_correlation(df, "p", "q", 25.0, crowded=crowded).collect()}
    assert got["nan"] == got["null"] == (None, None, None) and "no value" not in got
    for code, (r, n, radius) in brute_local(rows, 25.0).items():
        assert got[code][1:] == (n, radius) and (r is None) == (got[code][0] is None) and (r is None or abs(r - got[code][0]) < 1e-7)


def test_dense_discs_meet_cells_in_place_of_rows(spark):
    """Forty thousand rows round a hundred centres: fewer parts by an order of magnitude than rows in the discs' squares."""
    from zonalis.operators import stats

    rng = np.random.default_rng(13)
    rows = [(i, float(2 + a), float(48 + b), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.5, 0.5, (40_000, 2)))]
    df = spark.createDataFrame(rows, "code int, lon double, lat double, x double, y double")
    centres = df.where("code < 100 and abs(lon - 2) < 0.1 and abs(lat - 48) < 0.1")
    parts = stats.disc_parts(centres, df, [25.0], "code").cache()
    d2 = ((np.array([r[1] for r in rows]) - 2) * 111.32 * np.cos(np.radians(48))) ** 2 + ((np.array([r[2] for r in rows]) - 48) * 110.574) ** 2
    assert parts.count() < 0.1 * centres.count() * 40_000 and (d2 < 625).sum() > 8_000
    got = {r["code"]: r["n"] for r in parts.groupBy("code").agg(F.sum("n0").alias("n")).collect()}
    for code, n in got.items():
        _, lon, lat, *_ = rows[code]
        far = [((a - lon) * (111.320 * np.cos(np.radians(lat)))) ** 2 + ((b - lat) * 110.574) ** 2 for _, a, b, *_ in rows]
        assert n == sum(d <= 625 for d in far)


def test_local_correlation_searches_each_place_once(spark, monkeypatch):
    """Ten rows a place are one centre and one row of the search; ten rows of one place hide no neighbours."""
    from zonalis.operators import stats

    rng = np.random.default_rng(14)
    at = rng.uniform(-0.3, 0.3, (30, 2))
    rows = [(f"c{i}_{j}", float(2 + a), float(48 + b), 1e6 + float(rng.normal()), float(rng.normal())) for i, (a, b) in enumerate(at) for j in range(10)]
    df, seen, real = spark.createDataFrame(rows, "code string, lon double, lat double, p double, q double"), [], stats.disc_moments
    monkeypatch.setattr(stats, "disc_moments", lambda centres, *rest: seen.append(centres.count()) or real(centres, *rest))
    got = {r["code"]: (r["r"], r["n"], r["radius"]) for r in stats.local_correlation(df, "p", "q", 25.0, crowded=4).collect()}
    assert seen[0] == 30 and len(got) == 300
    for code, (r, n, radius) in brute_local(rows, 25.0).items():
        assert got[code][1:] == (n, radius) and abs(r - got[code][0]) < 1e-7


def test_thinning():
    x, y = np.arange(100.0), np.zeros(100)
    assert keep_mask(x, y, 0.5).sum() == 2
    y[50] = 5
    assert keep_mask(x, y, 0.5)[50] and keep_mask(x, y, 0.5).sum() == 5


@pytest.mark.parametrize("part", [5, 60, 100_000])
def test_long_lines_are_thinned_like_short_ones(spark, part):
    rng = np.random.default_rng(8)
    lines = {n: (np.cumsum(rng.uniform(0, 2, size)), np.cumsum(rng.normal(size=size))) for n, size in (("a", 300), ("b", 40), ("c", 2), ("d", 1))}
    df = spark.createDataFrame([(n, i, float(a), float(b)) for n, (x, y) in lines.items() for i, (a, b) in enumerate(zip(x, y))], "line string, pos int, x double, y double")
    got = {(r["line"], r["pos"]) for r in thinned(df.repartition(3), 1.5, part).collect()}
    assert got == {(n, int(i)) for n, (x, y) in lines.items() for i in (np.flatnonzero(keep_mask(x, y, 1.5)) if len(x) > 1 else [0])}
    assert thinned(df.where("pos < 0"), 1.5).count() == 0


def test_close_cuts_are_one_node(spark):
    cuts = spark.createDataFrame([(1, 0.0, "A"), (1, 0.3, "B"), (1, 0.6, "C"), (1, 10.0, "D")], "lid int, s double, node string")
    speeds = spark.createDataFrame([(1, 36.0, False)], "lid int, kmh double, lgv boolean")
    assert [(r["src"], r["dst"], round(r["length"], 6), round(r["seconds"], 6)) for r in N.cut_edges(cuts, speeds).collect()] == [("A", "D", 9.4, 0.94)]


def test_points_skip_their_own_line(spark):
    lines = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0, True), ("b", 0.0, 1.0, 10.0, 1.0, False), ("c", 0.0, 2.0, 10.0, 2.0, False), ("d", 0.0, 2.1, 10.0, 2.1, True)], "lid string, x0 double, y0 double, x1 double, y1 double, lgv boolean")
    ends = spark.createDataFrame([(1, 5.0, 0.0, "a")], "pid int, x double, y double, own string")
    assert [(r["lid"], r["away"]) for r in N.snapped_points(ends, lines, 3.0).collect()] == [("b", 1.0)]
    stop = spark.createDataFrame([(1, 5.0, 0.4)], "pid int, x double, y double")
    assert {(r["lid"], r["home"]) for r in N.station_lines(stop, lines, 3.0, 0.5).collect()} == {("a", True), ("b", False)}
    assert {r["lid"] for r in N.station_lines(stop, lines, 3.0, 2.0).collect()} == {"a", "b", "c"}


def test_negative_seconds_are_an_error(spark):
    edges = spark.createDataFrame([(1, 2, 1, -1.0, False, 1.0)], "src int, dst int, piece int, seconds double, lgv boolean, length double")
    with pytest.raises(ValueError, match="less than no time"):
        N.quickest(edges, spark.createDataFrame([(1,)], "source int"))


def test_unconverged_fit_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 5.0, 1.0)], "a double, y double, e double")
    with pytest.raises(ValueError):
        M.fit_poisson(df, ["a"], "y", "e", 0.1, rounds=1)


def newton(x, y, offset, ridge):
    a = np.column_stack([np.ones(len(x)), x])
    pen, beta = np.array([0.0] + [ridge] * x.shape[1]), np.zeros(x.shape[1] + 1)
    beta[0] = np.log(y.sum() / np.exp(offset).sum())
    loss = lambda b: (np.exp(a @ b + offset) - y * (a @ b + offset)).sum() + 0.5 * (pen * b * b).sum()
    for _ in range(200):
        mu = np.exp(a @ beta + offset)
        step = np.linalg.solve((a.T * mu) @ a + np.diag(pen), a.T @ (y - mu) - pen * beta)
        t = 1.0
        while not loss(beta + t * step) <= loss(beta) + 1e-9 and t > 1e-9:
            t /= 2
        beta = beta + t * step
    return beta


def test_poisson_fit_from_starts_that_overshoot(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.standard_normal(300), rng.standard_normal(300) ** 3])
    y = rng.poisson(np.exp(-1.0 + np.clip(x @ [0.9, 0.5], -9, 3))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(n), 2.0) for (a, b), n in zip(x, y)], "a double, b double, y double, e double")
    want = newton(x, y, np.full(300, np.log(2.0)), 1.0)
    for start in (None, [-30.0, 0.0, 0.0], [5.0, -3.0, 2.0], [0.0, 40.0, -40.0]):
        assert np.allclose(M.fit_poisson(df, ["a", "b"], "y", "e", 1.0, start=start), want, atol=1e-7)


def test_poisson_fit_without_an_answer_is_an_error(spark):
    rows = [(1.0, 2.0, 3.0, 1.0), (2.0, 4.0, 1.0, 1.0), (3.0, 6.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double, e double")
    with pytest.raises(ValueError, match="need a ridge"):
        M.fit_poisson(df, ["a", "b"], "y", "e", 0.0)
    with pytest.raises(ValueError, match="no events"):
        M.fit_poisson(df.withColumn("y", F.lit(0.0)), ["a"], "y", "e")
    nan = spark.createDataFrame([*rows, (float("nan"), 1.0, 2.0, 1.0), (1.0, 1.0, 2.0, 0.0), (None, 1.0, 2.0, 1.0)], df.schema)
    assert np.allclose(M.fit_poisson(nan, ["a"], "y", "e"), M.fit_poisson(df, ["a"], "y", "e"))


def test_fire_model_equals_a_plain_fit(spark):
    """The rows of the registered query on a table where plain Newton steps diverge."""
    from zonalis.plans import area_pipelines as P
    from zonalis.plans import catalogue, q_pipelines_more

    v = catalogue.Views(spark, "/root/testdata/sf0.01")
    areas, count, seasons, wind = q_pipelines_more.fire_inputs(v)
    rows, z = P.fire_features(P.with_wind(areas, wind, 0.5), count(1993, 1997), {"sud": ["00"], "est": ["01"]}, 0.5, 5)
    d = rows.select("code", "events", "exposure", *z).toPandas()
    beta = newton(d[z].to_numpy(float), d["events"].to_numpy(float), np.log(d["exposure"].to_numpy(float)), 1.0)
    rate = dict(zip(d["code"], np.exp(beta[0] + d[z].to_numpy(float) @ beta[1:]) * P.PER_KM2_DECADE))
    out = catalogue.queries()["p26_fire_model"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(rate) and all(abs(r["rate"] - rate[r["code"]]) < 0.0006 for r in out)
    assert all(r["auc_rate"] is not None and 0 <= r["capture"] <= 1 for r in out)


def test_nearest_takes_as_many_rounds_for_any_gap(spark, monkeypatch):
    """A dense cluster, points at distances of 2^4 to 2^22 cells from it, and two sites far apart."""
    rng = np.random.default_rng(5)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 8, (200, 2)))] + [(900, 3.0e6, -2.0e6), (901, -5.0e5, 0.0)]
    points = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 8, (50, 2)))] + [(f"far{k}", float(2.0**k), float(-(1.7**k))) for k in range(3, 22)] + [("mid", 1.2e6, -1.0e6)]
    rounds = []
    real = S.cut
    monkeypatch.setattr(S, "cut", lambda df: rounds.append(1) or real(df))
    ids, at = spark.createDataFrame(points, "id string, x double, y double"), spark.createDataFrame(sites, "site bigint, sx double, sy double")
    got = {r["id"]: (r["site"], r["distance"]) for r in S.nearest(ids, at, 0.5).collect()}
    for name, x, y in points:
        d, site = min((float(np.hypot(sx - x, sy - y)), i) for i, sx, sy in sites)
        assert got[name][0] == site and abs(got[name][1] - d) <= 1e-9 * d
    assert len(rounds) <= 9


def test_nearest_returns_every_point(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, 1.0), ("c", 3e9, 0.0), ("d", float("nan"), 0.0)], "id string, x double, y double")
    sites = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 0.0)], "site bigint, sx double, sy double")
    got = {r["id"]: r["site"] for r in S.nearest(points, sites, 0.5).collect()}
    assert got == {"a": 1, "b": None, "c": 1, "d": None}


def test_routed_hops_query_equals_dijkstra(spark, sf):
    from zonalis.plans import catalogue, q_networks

    v = catalogue.Views(spark, sf)
    got = {(r["grp"], r["a"], r["b"]): r for r in catalogue.queries()["r4_r5_r6_routed_hops"](spark, sf).collect()}
    edges = [tuple(r) for r in q_networks.lattice(v).select("src", "dst", "piece", "seconds", "lgv").collect()]
    nodes = sorted(r["poly"] for r in v.squares.collect())
    trips = {}
    for r in v.patterns.collect():
        trips.setdefault((r["trip"], r["product"]), []).append((r["pos"], r["stop"]))
    wanted = set()
    for (_, product), calls in trips.items():
        stops = [s for _, s in sorted(calls)]
        if product != "5-LOW":
            wanted |= {("fast" if product == "1-URGENT" else "rail", min(a, b), max(a, b)) for a, b in zip(stops, stops[1:]) if a != b}
    assert set(got) == wanted and len({a for _, a, _ in wanted}) > 3
    near = {}
    for a, b, piece, seconds, lgv in edges:
        near.setdefault(a, []).append((b, seconds, lgv))
        near.setdefault(b, []).append((a, seconds, lgv))
    ways = {}
    for grp, a, _ in wanted:
        if (grp, a) in ways or a >= len(nodes):
            continue
        best, heap = {nodes[a]: 0.0}, [(0.0, nodes[a])]
        while heap:
            cost, node = heapq.heappop(heap)
            for to, s, lgv in near.get(node, []) if cost <= best[node] else []:
                c = cost + s * (4 if lgv and grp == "rail" else 1)
                if c < best.get(to, float("inf")):
                    best[to] = c
                    heapq.heappush(heap, (c, to))
        ways[grp, a] = best
    for (grp, a, b), r in got.items():
        if b >= len(nodes):
            assert r["outcome"] == "stop off the network"
        elif nodes[b] not in ways[grp, a]:
            assert r["outcome"] == "no connected track"
        elif r["outcome"] == "routed":
            assert abs(r["cost"] - ways[grp, a][nodes[b]]) < 1e-6 and r["metres"] == 50_000.0 * len(r["numbers"])
        else:
            assert r["outcome"] == "route far longer than the crow flies"
    used = {n for r in got.values() for n in r["numbers"] or []}
    assert used == set(range(len(used))) and used


def test_sums_within_deal_their_cells(spark):
    """Few bytes can have many pairs; they are not left to the one task that adaptive execution would make of them."""
    points = spark.range(400).selectExpr("id % 20 * 1.0 as x", "id div 20 * 1.0 as y")
    sites = points.selectExpr("x as rx", "y as ry", "1.0D as w")
    seen = []
    real = S.pairs_within
    S.pairs_within = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
    try:
        out = S.sums_within(points, sites, 2.0, {"n": ("w", lambda d: F.lit(1))})
    finally:
        S.pairs_within = real
    assert seen[0].rdd.getNumPartitions() == 4
    assert out.count() == 400 and out.agg(F.max("n")).first()[0] == 13.0


def test_wind_days_read_the_days_once(spark, tmp_path):
    from zonalis.plans import area_pipelines as P

    reads = spark.sparkContext.accumulator(0)
    days = [(1, 0.0, 0.0, y, m, 6.0 * (m % 2)) for y in (1, 2) for m in (1, 2, 3)]

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    schema = "point int, x double, y double, year int, month int, wind double"
    out = P.wind_days(spark.createDataFrame(days, schema).mapInArrow(counted, schema), (1, 2, 3), 5.0).collect()
    assert [(r["point"], r["days"]) for r in out] == [(1, 2.0)] and reads.value == len(days)


def test_equally_near_lines_go_to_the_smaller_one(spark):
    """A point midway between two lines, whose distances differ in the last bits only."""
    lines = spark.createDataFrame([("b", 0.0, 0.1, 1.0, 0.1), ("a", 0.0, 0.5, 1.0, 0.5)], "lid string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(i, 0.5, 0.3 + e) for i, e in enumerate((-1e-16, 0.0, 1e-16, -1e-3))], "pid int, x double, y double")
    got = {r["pid"]: r["lid"] for r in N.snapped_points(points, lines, 0.3).collect()}
    assert got == {0: "a", 1: "a", 2: "a", 3: "b"}
