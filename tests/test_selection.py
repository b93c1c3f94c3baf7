import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.operators import ranking, selection

LEVELS = [0.0, 0.1, 0.5, 0.73, 1.0]


def found(df, group=()):
    rows = selection.quantiles(df, "v", LEVELS, group).collect()
    return {(*(r[g] for g in group), r.level): r.quantile for r in rows}


def test_groups_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 32)
    monkeypatch.setattr(selection, "FEW", 20)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=500), "b": 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300), "c": np.full(90, 7.5),
              "d": np.append(np.zeros(900), rng.integers(-3, 4, 100)), "e": np.array([3.0]), "f": np.array([-1.7e308, 1.7e308, 0.0])}
    rows = [(g, float(x), "spare") for g, values in groups.items() for x in values]
    rows += [("a", None, ""), ("a", float("nan"), ""), ("a", float("inf"), ""), ("g", None, "")]
    got = found(spark.createDataFrame(rows, "g string, v double, value string"), ["g"])
    assert len(got) == len(LEVELS) * len(groups)
    for g, values in groups.items():
        for level in LEVELS:
            position = (len(values) - 1) * level
            low, high = np.sort(values)[[int(np.floor(position)), int(np.ceil(position))]]
            assert got[g, level] == pytest.approx(low + (position - np.floor(position)) * (high - low), rel=1e-12)


def test_ungrouped_and_empty(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 16)
    monkeypatch.setattr(selection, "FEW", 3)
    values = np.arange(1000) % 37
    got = found(spark.createDataFrame([(int(v),) for v in values], "v long"))
    assert [got[level,] for level in LEVELS] == pytest.approx([np.quantile(values, level) for level in LEVELS])
    assert found(spark.createDataFrame([], "v double")) == {}


def test_one_hot_value_is_spread(spark):
    """Nine tenths of the rows share a value: they lie in many slices, and ranks stay averages."""
    df = spark.range(20000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(5000)).cast("double").alias("v"))
    ranked = ranking.percentile_rank(df, "v")
    got = {r.id: r.pct for r in ranked.collect()}
    values = np.array([i if i % 10 == 0 else 5000 for i in range(20000)])
    order = np.sort(values)
    expected = (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2 / len(values)
    assert [got[i] for i in range(20000)] == pytest.approx(list(expected))
    sliced = df.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(ranking.slices(spark), "v", "row_no")
    most = sliced.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 2 * 20000 / ranking.slices(spark)
