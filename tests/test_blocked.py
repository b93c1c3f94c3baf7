import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbflow.operators import blocked, calibrate, stats


def correlation(x, y):
    return np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_resamples_against_plain_draws(spark, monkeypatch, block):
    monkeypatch.setattr(blocked, "BLOCK", block)
    rng = np.random.default_rng(7)
    groups = {"a": rng.integers(0, 9, (70, 2)).astype(float), "b": rng.normal(size=(33, 2)), "few": rng.normal(size=(3, 2)), "flat": np.ones((9, 2))}
    rows = [(g, i, float(x), float(y)) for g, values in groups.items() for i, (x, y) in enumerate(values)]
    sums = blocked.resample_correlations(spark.createDataFrame(rows, "metric string, slot int, x double, y double"), "metric", 40, 42, chunk=8)
    got = {(r.metric, r.boot): r.rho for r in sums.withColumn("rho", stats._rho()).collect()}
    assert len(got) == 41 * len(groups)
    for g, values in groups.items():
        sizes = np.array([len(range(first, min(first + block, len(values)))) for first in range(0, len(values), block)])
        for boot in range(-1, 40):
            weights = np.concatenate([blocked.resample_weights(42, boot, b, sizes) for b in range(len(sizes))]).astype(int)
            assert weights.sum() == len(values)
            drawn = np.repeat(values, weights, axis=0)
            if g in ("few", "flat") or len(set(drawn[:, 0])) < 2:
                assert got[g, boot] is None
            else:
                assert got[g, boot] == pytest.approx(correlation(*drawn.T), abs=1e-12)


def test_draws_are_even():
    counts = sum(np.bincount(blocked.picks(42, b, 0, 500, 500), minlength=500) for b in range(400))
    assert abs(counts.mean() - 400) < 1e-9 and 0.8 < counts.var() / 400 < 1.25
    first, second = (np.bincount(blocked.picks(42, b, 0, 5000, 5000), minlength=5000) for b in (1, 2))
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.05 and 0.35 < (first == 0).mean() < 0.39


@pytest.mark.parametrize("block", [8, 1 << 14])
def test_search_against_plain_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(blocked, "BLOCK", block)
    rng = np.random.default_rng(9)
    parts = rng.integers(0, 4, (60, 4)) / 3.0
    ratio = np.round(1 + rng.integers(0, 12, 60) / 10, 4)
    names = ["lane_blockage", "intersection_impact", "access_blockage", "vehicle_size"]
    rows = [(f"z{i}", float(ratio[i]), "train", *map(float, parts[i])) for i in range(60)] + [("t", 9.0, "test", 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, ", ".join(["zone_id string", "measured_ratio double", "split string", *[f"{n} double" for n in names]]))
    got = {r.candidate: r.rho for r in calibrate.search_weights(frame, 150).collect()}
    pool = calibrate.candidates(spark, 150, calibrate.V.SEARCH_SEED).orderBy("candidate").select(*[f"weight_{n}" for n in calibrate.V.ROAD_COMPONENTS]).toPandas().to_numpy()
    columns = parts[:, [names.index(n) for n in calibrate.V.ROAD_COMPONENTS]]
    assert len(got) == 155
    for candidate, weights in enumerate(pool):
        predicted = np.floor((columns * weights).sum(axis=1) * 1e9 + 0.5)
        assert got[candidate] == pytest.approx(correlation(predicted, ratio), abs=2e-9)


def test_nothing_grows_with_candidates_times_rows(spark):
    """The plan of the search moves blocks and sums: no row a candidate and zone."""
    rows = spark.range(3000).selectExpr("concat('z', id) AS zone_id", "1 + id % 97 / 100D AS measured_ratio", "'train' AS split", *[f"pmod(xxhash64({i}, id), 1000) / 1000D AS {n}" for i, n in enumerate(calibrate.V.ROAD_COMPONENTS)])
    found = calibrate.search_weights(rows, 500)
    assert found.count() == 505
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "Window" not in plan
    assert found.agg(F.max("rho")).first()[0] < 0.2


@pytest.mark.parametrize("size", [8, 1 << 20])
def test_search_over_stored_blocks(spark, monkeypatch, size):
    """No vector is shuffled after the blocks are stored, and their number does not show in the result."""
    monkeypatch.setattr(blocked, "VECTORS", size)
    rng = np.random.default_rng(4)
    names = calibrate.V.ROAD_COMPONENTS
    parts = rng.integers(0, 4, (60, 4)) / 3.0
    ratio = np.round(1 + rng.integers(0, 12, 60) / 10, 4)
    rows = [(f"z{i}", float(ratio[i]), "train", *map(float, parts[i])) for i in range(60)]
    found = calibrate.search_weights(spark.createDataFrame(rows, ", ".join(["zone_id string", "measured_ratio double", "split string", *[f"{n} double" for n in names]])), 40)
    got = {r.candidate: r.rho for r in found.collect()}
    pool = calibrate.candidates(spark, 40, calibrate.V.SEARCH_SEED).orderBy("candidate").select(*[f"weight_{n}" for n in names]).toPandas().to_numpy()
    for candidate, weights in enumerate(pool):
        assert got[candidate] == pytest.approx(correlation(np.floor((parts * weights).sum(axis=1) * 1e9 + 0.5), ratio), abs=2e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "others" not in plan and "pool" not in plan
