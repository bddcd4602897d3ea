"""Operators against brute force, golden values and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns as c
from sparkloom.functions import payloads
from sparkloom.functions import tables as T
from sparkloom.operators import aggs, cluster, dispatch, forecast, graph, joins, repairs, scoring, spatial
from sparkloom.sources import readers


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_lists_and_severity(spark):
    rows = [(None, []), ("", []), ("['A','B']", ["A", "B"]), ('["A"]', ["A"]), ("A, B", ["A", "B"]), ("[A,B]", ["A", "B"]), ("5", ["5"]), ("('x',)", ["x"])]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    assert [r.x for r in df.select("i", c.parse_list("s").alias("x")).orderBy("i").collect()] == [r[1] for r in rows]
    tags = spark.createDataFrame([(["PARKING NEAR ROAD CROSSING"],), (["PARKING IN A MAIN ROAD"],), ([],), (["x", "double  parking"],)], "t array<string>")
    got = tags.select(c.severity_exact(F.col("t")), c.severity(F.col("t")), c.dominant_matched(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1, 5, "PARKING NEAR ROAD CROSSING"), (1, 1, "PARKING IN A MAIN ROAD"), (1, 1, "NO PARKING"), (1, 5, "DOUBLE PARKING")]


@pytest.mark.parametrize("counts, growth, multiplier", [([42, 2], -0.9523809523582767, 1.0), ([7], 0.0, 1.0), ([1, 2, 3], 1.5, 2.5), ([2, 2, 4, 4, 4], 1.0, 2.0)])
def test_growth_of_observed_weeks(spark, counts, growth, multiplier):
    rows = [(1, f"2024-01-{1 + 7 * i:02d}") for i, n in enumerate(counts) for _ in range(n)]
    r = aggs.half_growth(aggs.weekly(spark.createDataFrame(rows, "k int, week_start string"), "k"), "k").first()
    assert r.growth == pytest.approx(growth, abs=1e-8) and r.multiplier == pytest.approx(multiplier, abs=1e-8)


def test_route_follows_the_golden_stops(spark):
    # fixed values: stops, their places and legs in metres
    stops = [(16, 12.971356912928758, 77.59757005382586, 322.9605691626171), (20, 12.965108344385026, 77.57599985347593, 2438.4083561091747), (55, 12.94463117718121, 77.57114230436243, 2337.0101955128225), (257, 12.928616228735631, 77.58070089425287, 2060.1572097223457), (658, 12.92831098, 77.58075038615384, 34.36330324899962), (560, 12.92839076304348, 77.58117682521739, 47.0585514159343)]
    df = spark.createDataFrame([(k, la, lo, 50.0 - i) for i, (k, la, lo, _) in enumerate(reversed(stops))], "k int, lat double, lon double, s double")
    got = dispatch.greedy_route(df, "k", "s", (12.9716, 77.5946)).orderBy("seq").collect()
    assert [r.k for r in got] == [s[0] for s in stops]
    assert all(abs(r.leg_m - s[3]) < 0.05 for r, s in zip(got[:5], stops, strict=False))
    assert got[-1].total_m == pytest.approx(sum(r.leg_m for r in got))


def test_allocation(spark):
    df = lambda scores: spark.createDataFrame(list(enumerate(map(float, scores))), "k int, s double")
    few = values(dispatch.allocate(df([90, 60, 50, 10]), "k", "s", units=8), "k", "patrols")
    assert few == {0: 3, 1: 3, 2: 2, 3: 0} or sum(few.values()) <= 8 and few[0] >= few[1] >= few[2] >= 1 and few[3] == 0
    assert values(dispatch.allocate(df([5, 4, 3, 2]), "k", "s", units=2), "k", "patrols") == {0: 1, 1: 1, 2: 0, 3: 0}
    assert sum(values(dispatch.allocate(df(range(41, 71)), "k", "s", units=15), "k", "patrols").values()) == 15


def brute_dbscan(x, t, eps, days, least):
    n = len(x)
    near = [[j for j in range(n) if np.hypot(*(x[i] - x[j])) <= eps and abs(t[i] - t[j]) <= days] for i in range(n)]
    label, k = [-1] * n, 0
    seen = [False] * n
    for i in range(n):
        if seen[i] or len(near[i]) < least:
            continue
        k += 1
        queue = [i]
        seen[i] = True
        while queue:
            p = queue.pop()
            if label[p] < 0:
                label[p] = k
            if len(near[p]) >= least:
                for q in near[p]:
                    if label[q] < 0:
                        label[q] = k
                    if not seen[q] and len(near[q]) >= least:
                        seen[q] = True
                        queue.append(q)
    return label


@pytest.mark.parametrize("seed, least", [(1, 6), (2, 6), (3, 3), (4, 4)])
def test_st_dbscan_equals_a_scan(spark, seed, least):
    r = np.random.default_rng(seed)
    # apart with noise, or strewn evenly so that cells of all kinds touch at the very limit
    place = r.uniform((12.97, 77.59), (12.982, 77.602), (420, 2)) if least < 6 else np.concatenate([r.normal(p, 0.0007, (60, 2)) for p in ((12.97, 77.59), (12.974, 77.593), (12.95, 77.6))] + [r.uniform((12.94, 77.58), (12.98, 77.61), (40, 2))])
    days = r.uniform(0, 9, len(place))
    order = np.argsort(days)
    place, days = place[order], days[order]
    df = spark.createDataFrame([(i, float(p[0]), float(p[1]), float(d)) for i, (p, d) in enumerate(zip(place, days, strict=True))], "id long, latitude double, longitude double, days double")
    xy = np.array([(v.x, v.y) for v in spatial.projected(df).orderBy("id").collect()])
    got = values(cluster.st_dbscan(df, min_points=least), "id", "cluster_id")
    want = brute_dbscan(xy, days, 150.0, 3.0, least)
    assert [got[i] for i in range(len(want))] == want and len(set(want)) > 1


def test_components_equal_union_find(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (330, 2))] + [(900 + i, 901 + i) for i in range(70)] + [(5, 5), (2000, 2001)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = values(graph.components(spark.createDataFrame(edges, "src long, dst long")), "node", "component")
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node int")
    edges = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 1.0), (3, 0, 1.0), (4, 5, 1.0), (3, 4, 0.0)]
    got = values(graph.pagerank(nodes, spark.createDataFrame(edges, "src int, dst int, weight double")), "node", "pagerank")
    x = np.full(6, 1 / 6)
    m = np.zeros((6, 6))
    for a, b, w in edges:
        m[b, a] += w
    for _ in range(300):
        spare = sum(x[i] for i in range(6) if m[:, i].sum() == 0)
        x = 0.85 * (m / np.where(m.sum(0) == 0, 1, m.sum(0)) @ x + spare / 6) + 0.15 / 6
    assert sum(got.values()) == pytest.approx(1) and all(abs(got[i] - x[i]) < 1e-4 for i in range(6))
    none = values(graph.pagerank(nodes, spark.createDataFrame([], "src int, dst int, weight double")), "node", "pagerank")
    assert all(v == pytest.approx(1 / 6) for v in none.values())


def test_betweenness_equals_path_counts(spark):
    edges = [(0, 1), (1, 2), (2, 3), (1, 3), (3, 4), (5, 6)]
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node int")
    got = values(graph.betweenness(nodes, spark.createDataFrame(edges, "src int, dst int")), "node", "betweenness")
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(7)}

    def paths(s, t):
        level = [[s]]
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [p + [q] for p in level for q in near[p[-1]] if q not in p]
        return []

    want = dict.fromkeys(range(7), 0.0)
    for s, t in itertools.combinations(range(7), 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    assert all(abs(got[i] - want[i] / 15) < 1e-9 for i in range(7))


def test_hulls(spark):
    shapes = {1: [(0, 0)], 2: [(0, 0), (3, 4)], 3: [(i, i) for i in range(5)], 4: [(0, 0), (100, 0), (100, 100), (0, 100), (50, 50), (0, 0)]}
    rows = [(k, float(x), float(y)) for k, ps in shapes.items() for x, y in ps]
    got = values(cluster.hull_area(spark.createDataFrame(rows, "k int, x double, y double"), "k"), "k", "area_m2")
    assert got == {1: 1000.0, 2: 1000.0, 3: 1000.0, 4: 10000.0}


def test_spatial_joins_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    p = np.concatenate([r.uniform((12.9, 77.5), (12.96, 77.56), (80, 2)), r.uniform((59.97, 10.0), (60.03, 10.1), (60, 2)), r.uniform((-0.01, -0.01), (0.01, 0.01), (30, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k int, lat double, lon double")

    def far(a, b):
        la, lb = math.radians(a[0]), math.radians(b[0])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {(i, j) for i, j in itertools.combinations(range(len(p)), 2) if 0 < far(p[i], p[j]) <= 1200}
    assert {(r.a, r.b) for r in spatial.within(df, "k", "lat", "lon", 1200.0).collect()} == want
    targets = df.where("k % 9 = 0").withColumnRenamed("k", "t")
    got = values(spatial.nearest(df, "k", targets, "t"), "k", "t")
    assert got == {i: min(range(0, len(p), 9), key=lambda j: (far(p[i], p[j]), j)) for i in range(len(p))}


@pytest.mark.parametrize("most", [250_000, 40])
def test_near_counts_equal_all_pairs(spark, most):
    r = np.random.default_rng(6)
    free = [(float(x), float(y), float(t)) for x, y, t in r.uniform((-400, -400, 19700), (400, 400, 19712), (250, 3))]
    # copies, a grid where distances and days are the limits themselves, and cells' borders
    grid = [(30.0 * (i % 11), 40.0 * (i % 7) - 120, 19704 + 1.5 * (i % 9)) for i in range(150)]
    odd = [(600.0, 0.0, 19704.0), (450.0, 0.0, 19701.0), (750.0, -0.0, 19707.0), (None, 0.0, 19704.0), (0.0, float("nan"), 19704.0), (0.0, 0.0, float("inf")), (0.0, 0.0, None), (1e9, 0.0, 19704.0)]
    rows = [(i // 2 if i < 20 else i, *p) for i, p in enumerate(free + grid + odd)]
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 19704.0)], "k int, x double, y double, t double")
    near = lambda p, q: None not in p and None not in q and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 22500 and abs(p[2] - q[2]) <= 3
    want: dict = {}
    for k, *p in [*rows, (None, 0.0, 0.0, 19704.0)]:
        n = near(p, p) and sum(near(p, q) for _, *q in [*rows, (None, 0.0, 0.0, 19704.0)])
        if n:
            want[k] = want.get(k, 0) + n
    assert values(spatial.near_counts(df, "k", time="t", most=most), "a", "n") == want
    flat = values(spatial.near_counts(df.drop("t"), "k", most=most), "a", "n")
    assert flat == values(spatial.near_pairs(df.drop("t"), "k").groupBy("a").agg(F.count("*").alias("n")), "a", "n")


def test_near_counts_make_no_pairs(spark):
    p = "CASE WHEN id % 2 = 0 THEN id % 997 ELSE 0 END"
    df = spark.range(300_000).selectExpr("id AS k", f"0.05 * ({p}) AS x", f"0.03 * ({p}) AS y", "19700 + id / 1e6 AS t")  # 9e10 pairs
    got = spatial.near_counts(df, "k", time="t").agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(got) == (300_000,) * 3


@pytest.mark.parametrize("leaf", [1, 16])
def test_near_weights_and_ranks_at_the_limits(leaf):
    r = np.random.default_rng(7)
    at, times = np.array([3.0, 3.0 - 2**-51, 0.0, 5.5, 9.0, 20.0]), np.unique(np.concatenate([[0.0, 2.0**-52, 3.0, 6.0, 8.5], r.uniform(0, 12, 40)]))
    low, high = spatial.time_ranks(at, times, 3.0)
    assert [set(range(a, b)) for a, b in zip(low, high, strict=True)] == [set(np.flatnonzero(np.abs(v - times) <= 3.0)) for v in at]
    a, b, rank, weight = r.integers(-40, 40, (300, 2)) * 10.0, r.integers(-40, 40, (400, 2)) * 10.0, np.sort(r.integers(0, 50, 400)), r.integers(1, 5, 400)
    low = r.integers(0, 50, 300)
    got = spatial.near_weights(*a.T, low, low + 20, *b.T, rank, weight, 22500.0, leaf=leaf)
    near = (((a[:, None] - b) ** 2).sum(2) <= 22500.0) & (rank >= low[:, None]) & (rank < low[:, None] + 20)
    assert got.tolist() == (near * weight).sum(1).tolist() and got.max() > 20


def test_nearest_skips_missing_coordinates_and_reaches_everywhere(spark):
    points = spark.createDataFrame([(1, None, 5.0), (2, 0.0, 179.999), (3, -60.0, -100.0), (4, float("nan"), 1.0), (5, 10.0, 10.0)], "k int, lat double, lon double")
    targets = spark.createDataFrame([(7, 0.0, -179.999), (8, 0.0, 179.0), (9, None, None), (6, 10.0, 10.0), (5, 10.0, 10.0)], "t int, lat double, lon double")
    got = values(spatial.nearest(points, "k", targets, "t"), "k", "t")
    assert got == {2: 7, 3: 7, 5: 5}
    assert spatial.nearest(points, "k", targets.where("FALSE"), "t").collect() == []


def test_source_pressure_falls_back_when_all_is_flat(spark):
    names = [k for k in T.PRESSURE_WEIGHTS if k not in ("growth_surge", "context_boost")]
    row = {**dict.fromkeys(names, 1.0), "growth_pct_change": -0.5, "context_multiplier": None}
    schema = "k int, " + ", ".join(f"{k} double" for k in row)
    flat = spark.createDataFrame([(i, *row.values()) for i in range(3)], schema)
    assert values(scoring.source_pressure(flat), "k", "source_pressure_score") == {0: 50.0, 1: 50.0, 2: 50.0}
    some = flat.withColumn("ccs_score", F.col("k").cast("double")).withColumn("rop", 2.0 - F.col("k"))
    got = values(scoring.source_pressure(some), "k", "source_pressure_score")
    # two components differ: their weighted mean over the weights that count
    assert abs(got[0] - 100 * 0.06 / 0.31) < 1e-4 and abs(got[2] - 100 * 0.25 / 0.31) < 1e-4 and abs(got[1] - 50) < 1e-4


def test_norms_of_constants_nulls_and_infinities(spark):
    df = spark.createDataFrame([(1, 1.0, None, 1.0), (2, 1.0, None, float("inf")), (3, 1.0, None, None), (4, 1.0, None, 5.0)], "k int, a double, b double, x double")
    out = scoring.minmax(df, ["a", "b", "x"], nulls="least").orderBy("k").collect()
    assert [r.a_norm for r in out] == [0] * 4 and [r.b_norm for r in out] == [0] * 4
    assert [round(r.x_norm, 6) for r in out] == [0, 0, 0, 1]
    assert [r.a_norm for r in scoring.active_minmax(df, ["a"]).collect()] == [None] * 4
    assert {r.s for r in scoring.weighted(df, {"a": 1.0, "b": 1.0}, "s").collect()} == {0.0}
    assert all(0 <= r.x_norm <= 1 for r in scoring.robust(df, ["x"]).collect())
    g = scoring.geometric(df, {"a": 0.5, "x": 0.5}).collect()
    assert all(0 < r.ccs_score <= 100 for r in g)


@pytest.mark.parametrize("scores, want", [([10, 50, 70, 90], ["Watch", "Moderate", "High", "Critical"]), ([1, 1.5, 2, 2.5], ["Watch", "Watch", "High", "Critical"])])
def test_bands_fixed_or_by_quantiles(spark, scores, want):
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    assert [r.b for r in scoring.quantile_bands(df, "s", "b", fixed=(80, 60, 40)).orderBy("s").collect()] == want


def test_payload_shapes(spark):
    rows = ['{"results":[{"formattedAddress":" A "}]}', '{"copResults":{"poi":"P","city":"C","state":"C"}}', '{"city":"C"}', "{}", None, "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(payloads.address("p")["address"]).collect()] == ["A", "P, C", "C", "", "", ""]
    routes = ['{"results":{"trips":[{"duration":60,"length":700}]}}', '{"results":{"time":5}}', '{"routes":[{"distance":3}]}', '{"trip":{"summary":{"length":2,"time":9}}}', "{}", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(routes)], "i int, p string").orderBy("i").select(payloads.route("p").alias("r")).collect()
    assert [(r.r.distance_m, r.r.duration_sec) for r in got] == [(700, 60), (None, 5), (3, None), (2000, 9), (None, None), (None, None)]


def test_forecast_splits_predicts_and_is_stored(spark, tmp_path):
    r = np.random.default_rng(7)
    rows = [(k, w, float(x := r.normal()), "a" if k % 2 else "b", 2 * x + w * 0.1, int(x > 0)) for k in range(30) for w in range(10)]
    df = spark.createDataFrame(rows, "k int, w int, x double, t string, y double, up int")
    split = forecast.temporal_split(df, "w")
    assert {v.w for v in split.where("is_test").collect()} == {8, 9}
    model = forecast.fit(split.where("NOT is_test"), ["x"], ["t"], "y", "up", trees=8, depth=3)
    m = forecast.metrics(model.predict(split.where("is_test")), "y", "up")
    assert m["r2"] > 0.7 and m["auc"] > 0.9 and 0 <= m["brier"] <= 0.25
    assert forecast.importances(model)[0][1] > 0
    model.save(f"file://{tmp_path}/m")
    again = forecast.Forecast.load(f"file://{tmp_path}/m").predict(split).agg(F.sum("predicted"), F.sum("probability")).first()
    assert again == model.predict(split).agg(F.sum("predicted"), F.sum("probability")).first()


def test_isolation_ranks_an_outlier_first(spark):
    r = np.random.default_rng(8)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(200, 2)))] + [(999, 25.0, -25.0)]
    df = cluster.robust_scaled(spark.createDataFrame(rows, "k int, a double, b double"), ["a", "b"])
    got = values(cluster.isolation_scores(df, "k", ["a", "b"], trees=50), "k", "anomaly")
    assert max(got, key=got.get) == 999 and all(0 < v < 1 for v in got.values())


def test_readers(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a")], "id int, cluster_id string")
    readers.write(df, f"{path}/x.parquet")
    readers.write(df, f"{path}/y.csv", "csv")
    got, at = readers.first_existing(spark, [f"{path}/none", path], ["x.parquet"])
    assert at == f"{path}/x.parquet" and got.count() == 1 and readers.first_existing(spark, [f"{path}/none"]) == (None, None)
    assert len(readers.all_existing(spark, [f"{path}/x.parquet", f"{path}/y.csv", f"{path}/z"], ["cluster_id"])) == 2
    assert set(readers.bundle(spark, path, ["x", "q"])) == {"x"}
    with pytest.raises(ValueError, match="latitude"):
        readers.require(df)
    assert readers.resolve(df, ["cluster", "cluster_id"], "c").first().c == "a"
    assert readers.with_defaults(df, {"n": ("int", 7)}).first().n == 7 and readers.empty(spark, "a int").count() == 0
    assert readers.cached(spark, f"{path}/made.parquet", lambda: df).count() == 1


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("SPARKLOOM_PATROL_UNITS", "4")
    assert readers.Settings.from_environment().patrol_units == 4


def test_joins(spark):
    left = spark.createDataFrame([("a", None, 1), ("b", 5, None)], "k string, x int, y int")
    right = spark.createDataFrame([("a", 9, 8, 7)], "k string, x int, y int, z int")
    assert [tuple(r) for r in joins.fill_from(left, right, "k").orderBy("k").collect()] == [("a", 9, 1, 7), ("b", 5, None, None)]
    both = joins.union_first([left.select("k", "x"), right.select("k", "z")], "k")
    assert both.count() == 2


def test_average_precision_by_brute_force(spark):
    rows = [(0.9, 1.0), (0.9, 0.0), (0.7, 1.0), (0.4, 0.0), (0.4, 1.0), (0.1, 0.0)]
    want, hit = 0.0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        above = [u for v, u in rows if v >= s]
        want += sum(above) / len(above) * (sum(above) - hit) / 3
        hit = sum(above)
    df = spark.createDataFrame(rows, "s double, u double")
    assert forecast.average_precision(df, "s", "u") == pytest.approx(want)
    assert forecast.average_precision(df.where("u = 0"), "s", "u") == 0.0 == forecast.average_precision(df.where("false"), "s", "u")


def test_repairs_of_an_empty_table_and_of_nulls(spark):
    kinds = "cluster_id long, records long, vehicles long, severity_sum double, severity_mean double, peak_records long, distinct_days long, lam double, mu double, dwell double, load double, lanes double, carriageway double, road string, base double, loss double, reduced double, delay double, degree double, centrality double"
    bare = tuple([1, 4, 2] + [None] * 17)
    df = spark.createDataFrame([bare], kinds)
    assert repairs.criticality(repairs.repaired(df.where("false"))).count() == 0
    one = repairs.criticality(repairs.repaired(df)).first()
    assert (one.lanes, one.carriageway, one.base, one.loss, one.reduced, one.delay, one.criticality_factor) == (None, None, 1600.0, 0.0, 1600.0, 2.0, 1.0)


def test_collapse_takes_each_column_by_its_rule(spark):
    df = spark.createDataFrame([("a", 10, 5.0, 1.0, 2.0, "x", None, 1), ("a", 2, 5.0, 1.0, 3.0, "y", "p", 7), ("b", 3, None, None, None, None, None, None)], "place string, cluster_id long, ccs_score double, delay double, records double, risk_band string, road_class string, network_component_id int")
    got = {x.place: x for x in repairs.collapse(df, "place").collect()}
    assert (got["a"].merged_ids, got["a"].cluster_id, got["a"].records, got["a"].risk_band, got["a"].road_class, got["a"].network_component_id) == ("10|2", 2, 5.0, "y", "p", 7)
    assert (got["b"].records, got["b"].road_class, got["b"].network_component_id) == (0.0, "road", 0)
    assert repairs.collapse(df.where("false"), "place").count() == 0


def test_answers_of_a_service(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sparkloom.sources import http

    asked: list[str] = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            code = 204 if "empty" in self.path else 500 if "broken" in self.path or "late" in self.path and asked.count(self.path) < 3 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b"no json" if "text" in self.path else b'{"ok": 1}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([("late",), ("text",), ("empty",), ("broken",), (None,), ("a b/c",)], "q string")
    got = {x.q: x for x in http.fetch(df, [base + "/one/{q}"], retries=2, backoff=0.0).collect()}
    assert (got["late"].payload, got["late"].status, got["late"].endpoint) == ('{"ok": 1}', 200, 0)
    assert got["text"].payload == '{"_raw_text": "no json"}' and (got["empty"].payload, got["empty"].status, got["empty"].error) == (None, 204, "")
    assert got["broken"].payload is None and got["broken"].status == 500 and got["broken"].error and asked.count("/one/broken") == 3
    assert "/one/" in asked and "/one/a%20b%2Fc" in asked
    second = {x.q: x for x in http.fetch(df, [base + "/broken/{q}", base + "/two/{q}"], retries=0, backoff=0.0).collect()}
    assert second["late"].status == 500 and (second["text"].endpoint, second["text"].status) == (1, 200)
    assert http.fetch(df.where("false"), [base], retries=0).count() == 0
    server.shutdown()
