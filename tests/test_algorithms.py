import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbflow.operators import calibrate, cluster, degrade, neighbours, panel, ranking, selection, stats

RNG = np.random.default_rng(7)


def test_running_total_with_a_hot_group(spark):
    data = pd.DataFrame({"g": ["hot"] * 700 + list("abcdefghij") * 30, "i": range(1000), "v": RNG.integers(0, 20, 1000), "w": RNG.integers(1, 5, 1000)})
    got = ranking.running_total(spark.createDataFrame(data), [("v", False), ("i", True)], ["g"], "w").toPandas()
    data = data.sort_values(["g", "v", "i"], ascending=[True, False, True])
    data["before"] = data.groupby("g")["w"].cumsum() - data["w"]
    merged = got.merge(data, on=["g", "i"], suffixes=("_s", "_p"))
    assert (merged.before_s == merged.before_p).all() and len(merged) == 1000


def test_percentile_rank_averages_ties(spark):
    data = pd.DataFrame({"v": RNG.integers(0, 12, 300).astype(float)})
    got = sorted(r.pct for r in ranking.percentile_rank(spark.createDataFrame(data), "v").collect())
    assert np.allclose(got, sorted(data.v.rank(pct=True)))


def test_exact_quantiles(spark):
    data = pd.DataFrame({"g": RNG.choice(["a", "b"], 501, p=[0.9, 0.1]), "v": RNG.normal(size=501).round(1)})
    got = {(r.g, r.level): r.quantile for r in selection.quantiles(spark.createDataFrame(data), "v", [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for (g, level), value in got.items():
        assert abs(value - np.quantile(data.v[data.g == g], level)) < 1e-12
    assert len(got) == 8


@pytest.mark.parametrize("metric", [False, True])
def test_nearest_against_all_pairs(spark, metric):
    tight, wide = RNG.normal(0, 0.002, (120, 2)), RNG.uniform(-0.3, 0.3, (40, 2))
    xy = np.vstack([tight, wide]) + [12.9, 77.6]
    frame = spark.createDataFrame([(f"p{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "id string, x double, y double")
    got = neighbours.nearest(frame, frame, 4, metric).toPandas()
    assert len(got) == 640
    lat, lon = np.radians(xy[:, 0]), np.radians(xy[:, 1])
    if metric:
        h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        dist = 2 * 6371000 * np.arcsin(np.sqrt(h))
    else:
        dist = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    for i in range(len(xy)):
        mine = np.sort(got[got.src == f"p{i:03d}"].dist.to_numpy())
        assert np.allclose(mine, np.sort(dist[i])[:4], rtol=1e-9)


def brute_clusters(points, eps, least):
    lat, lon = np.radians(points[:, 0]), np.radians(points[:, 1])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    close = h <= np.sin(np.radians(eps) / 2) ** 2
    core = close.sum(1) >= least
    label = np.full(len(points), -1)
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        stack, label[start] = [start], start
        while stack:
            for k in np.flatnonzero(close[stack.pop()] & core):
                if label[k] < 0:
                    label[k] = start
                    stack.append(k)
    return close, core, label


def test_clusters_against_brute_force(spark):
    hot = RNG.normal(0, 0.0006, (400, 2)) + [12.95, 77.60]  # dense cells next to each other
    chain = np.column_stack([12.9 + np.arange(120) * 0.0004, 77.5 + RNG.normal(0, 0.0002, 120)])
    loose = RNG.uniform(0, 0.05, (150, 2)) + [12.88, 77.55]
    copies = np.repeat([[13.0, 77.7]], 12, axis=0)
    points = np.vstack([hot, chain, loose, copies])
    frame = spark.createDataFrame([("b", float(a), float(o)) for a, o in points], "time_bucket string, latitude double, longitude double")
    rows = cluster.labelled(frame, least=10).toPandas()
    close, core, label = brute_clusters(points, 0.003, 10)
    place = {(a, o): i for i, (a, o) in enumerate(map(tuple, points))}
    index = [place[(r.lat, r.lon)] for r in rows.itertuples()]
    assert rows.w.sum() == len(points)
    assert (rows.core.to_numpy() == core[index]).all()
    mine = {i: name for i, name in zip(index, rows.label)}
    inner = [i for i in index if core[i]]
    assert len({(label[i], mine[i]) for i in inner}) == len({label[i] for i in inner}) == len({mine[i] for i in inner})
    for i in index:
        if not core[i]:
            near = {mine[k] for k in index if close[i, k] and core[k]}
            assert mine[i] == (min(near) if near else None)


def test_components_on_paths_and_stars(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("s000", f"s{i:03d}") for i in range(1, 40)]
    names = sorted({n for e in edges for n in e} | {"alone"})
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    got = {r.node: r.label for r in cluster.components(nodes, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(got[n] == {"n": "n000", "s": "s000", "a": "alone"}[n[0]] for n in names)


def test_spearman_guards_and_value(spark):
    x = RNG.integers(0, 8, 60).astype(float)
    y = x + RNG.integers(0, 5, 60)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("few", 1.0, 2.0)] * 3 + [("flat", 1.0, float(i)) for i in range(9)]
    got = {r.g: r.rho for r in stats.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()}
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert abs(got["a"] - want) < 1e-12 and got["few"] is None and got["flat"] is None


def test_bootstrap_brackets_the_estimate(spark):
    x = np.arange(40.0)
    rows = [("m", f"z{i:02d}", float(x[i]), float(x[i] + RNG.normal(0, 12))) for i in range(40)]
    row = stats.bootstrap(spark.createDataFrame(rows, "metric string, zone_id string, x double, y double"), "metric", "zone_id", 200).first()
    assert row.n == 40 and row.lo < row.rho < row.hi <= 1 and row.p_approx == 0.0


def test_search_loads_on_the_driving_component(spark):
    rows = [(f"z{i:02d}", float(1 + 1.5 * v[0]), "train", *map(float, v)) for i, v in enumerate(RNG.uniform(size=(40, 4)))]
    frame = spark.createDataFrame(rows, "zone_id string, measured_ratio double, split string, lane_blockage double, "
                                        "intersection_impact double, access_blockage double, vehicle_size double")
    best = calibrate.best_candidate(calibrate.search_weights(frame, 300), 300).first()
    assert best.train_rho == 1.0 and best.lane_blockage == 1.0
    full = calibrate.assemble({"lane_blockage": 1.0, "intersection_impact": 0.0, "access_blockage": 0.0, "vehicle_size": 0.0})
    assert abs(sum(full.values()) - 1) < 1e-9 and full["traffic_degradation"] == 0.25
    ids = calibrate.candidates(spark, 500, 1).toPandas().filter(like="weight_")
    assert np.allclose(ids.sum(axis=1), 1.0) and (ids.to_numpy() >= 0).all()


def ridge(x, y, alpha):
    mean = np.nan_to_num(np.nanmean(x, axis=0))
    filled = np.where(np.isnan(x), mean, x)
    std = filled.std(axis=0)
    std[std == 0] = 1
    z = (filled - filled.mean(axis=0)) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda v: y.mean() + ((np.where(np.isnan(v), mean, v) - filled.mean(axis=0)) / std) @ w


def test_ridge_and_leave_one_out_against_refits(spark):
    x = RNG.uniform(size=(30, 6))
    x[RNG.uniform(size=x.shape) < 0.1] = np.nan
    y = np.clip(0.3 + 0.5 * np.nan_to_num(x[:, 0]) + RNG.normal(0, 0.05, 30), 0, 1)
    schema = "zone_id string, label double, " + ", ".join(f"{n} double" for n in degrade.FEATURES)
    clean = lambda v: None if np.isnan(v) else float(v)
    frame = spark.createDataFrame([(f"z{i}", float(y[i]), *map(clean, x[i])) for i in range(30)] + [("new", None, 0.2, 0.4, 0.1, 0.6, None, None)], schema)
    got = {r.zone_id: r for r in degrade.predictions(frame).collect()}
    new = np.array([0.2, 0.4, 0.1, 0.6, np.nan, np.nan])
    assert abs(got["new"].degradation - np.clip(ridge(x, y, 1.0)(new), 0, 1)) < 1e-9 and got["z0"].source == "measured"
    held = {r.zone_id: r.predicted for r in degrade.leave_one_out(frame).collect()}
    for i in range(30):
        rest = np.arange(30) != i
        assert abs(held[f"z{i}"] - np.clip(ridge(x[rest], y[rest], 1.0)(x[i]), 0, 1)) < 1e-8
    few = degrade.predictions(frame.where("zone_id IN ('z1', 'new')")).where("zone_id = 'new'").first()
    assert (few.degradation, few.source) == (0.5, "default_fallback")


def test_next_day_equals_the_extended_panel(spark):
    days = pd.date_range("2024-01-01", periods=20).date
    rows = [(z, d, int(RNG.integers(1, 9))) for z in ("a", "b", "c") for d in days if RNG.uniform() < 0.6] + [("a", days[0], 3), ("b", days[-1], 2)]
    daily = spark.createDataFrame(rows, "zone_id string, date date, n int").groupBy("zone_id", "date").agg(F.sum("n").alias("violation_count")).cache()
    future = {r.zone_id: r for r in panel.next_day(daily).collect()}
    spine = daily.unionByName(spark.createDataFrame([(z, days[-1] + pd.Timedelta(days=1), 0) for z in "abc"], "zone_id string, date date, violation_count long"))
    full = panel.day_features(panel.day_panel(spine)).where(F.col("date") == F.lit(days[-1] + pd.Timedelta(days=1)))
    for r in full.collect():
        for name in panel.DAY_FEATURES[:6]:
            assert abs(r[name] - future[r.zone_id][name]) < 1e-9, name


def test_precision_counts_overlap_only_for_full_groups(spark):
    rows = [(d, f"z{i:02d}", i, float(i if d == 1 else -i)) for d in (1, 2) for i in range(20)] + [(3, "z00", 5, 1.0)]
    got = stats.precision_at_k(spark.createDataFrame(rows, "d int, z string, a int, p double"), ["d"], "z", "a", "p", 10).first()
    assert got.groups == 2 and got.precision == 0.5
