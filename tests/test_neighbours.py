import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.operators import neighbours


def metres(a, b):
    up, across = np.sin(np.radians(b[:, 0] - a[0]) / 2), np.sin(np.radians(b[:, 1] - a[1]) / 2)
    return 12742000.0 * np.arcsin(np.sqrt(np.minimum(1, up * up + np.cos(np.radians(a[0])) * np.cos(np.radians(b[:, 0])) * across * across)))


@pytest.mark.parametrize("haversine,leaf,fan", [(False, 4, 3), (True, 4, 3), (True, 64, 64)])
def test_against_brute_force(spark, monkeypatch, haversine, leaf, fan):
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    monkeypatch.setattr(neighbours, "FAN", fan)
    rng = np.random.default_rng(3)
    targets = np.concatenate([rng.normal(size=(150, 2)), np.full((40, 2), 0.25), rng.uniform([-88, -180], [88, 180], (60, 2))])
    queries = np.concatenate([targets[::9], [[80.0, 179.5], [-80.0, -179.5], [0.25, 0.25]]])
    frame = lambda points, first: spark.createDataFrame([(first + i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    asked = frame(queries, 1000).unionAll(frame(targets[:20], 0))
    got = {}
    for r in neighbours.nearest(asked, frame(targets, 0), 5, haversine).collect():
        got.setdefault(r.src, []).append((r.place, r.dst, r.dist))
    for number, point in [*enumerate(queries, 1000), *enumerate(targets[:20])]:
        dist = metres(point, targets) if haversine else ((targets - point) ** 2).sum(axis=1)
        order = sorted((round(d, 6), i) for i, d in enumerate(dist) if i != number)[:5]
        rows = sorted(got[number])
        assert [round(d, 6) for _, _, d in rows] == pytest.approx([d for d, _ in order], abs=1e-5)
        if not haversine:
            assert [i for _, i, _ in rows] == [i for _, i in order]


def test_fewer_targets_than_asked(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    assert sorted((r.src, r.dst) for r in neighbours.nearest(df, df, 3).collect()) == [(1, 2), (2, 1)]
    assert neighbours.nearest(df, df.limit(0), 3).collect() == [] and neighbours.nearest(df.limit(0), df, 3).collect() == []


def test_isolated_points_meet_few_leaves(spark):
    """5,000 scattered points against a dense cluster of 100,000 targets."""
    unit = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) / float(1 << 20)
    targets = spark.range(100_000).select("id", unit(1).alias("x"), unit(2).alias("y"))
    queries = spark.range(5_000).select((F.col("id") + 10**7).alias("id"), (1000 * unit(3) - 500).alias("x"), (1000 * unit(4) - 500).alias("y"))
    placed, levels = neighbours.tree(targets, 100_000)
    sizes = placed.groupBy("strip", "tile").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= neighbours.LEAF and sizes[1] < 2 * 100_000 / neighbours.LEAF
    met = neighbours.candidate_leaves(queries, levels, 2, False).groupBy("src").agg(F.count("*").alias("n")).agg(F.count("*"), F.avg("n"), F.max("n")).first()
    assert met[0] == 5_000 and met[1] < 12 and met[2] <= 60


def test_points_of_a_narrow_band_meet_few_leaves(spark):
    """20,000 points in a band 600 times as long as wide lie in leaves about as long as wide."""
    unit = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) / float(1 << 20)
    targets = spark.range(20_000).select("id", (12.8 + 0.1 * unit(1)).alias("x"), (60 * unit(2)).alias("y"))
    placed, levels = neighbours.tree(targets, 20_000, True)
    assert placed.count() == 20_000 and placed.groupBy("strip", "tile").count().agg(F.max("count")).first()[0] <= neighbours.LEAF
    met = neighbours.candidate_leaves(targets, levels, 4, True).groupBy("src").agg(F.count("*").alias("n")).agg(F.count("*"), F.avg("n")).first()
    assert met[0] == 20_000 and met[1] < 12


@pytest.mark.parametrize("sides,pairs", [((4, 8), 64), ((16, 64, 256), 1 << 22)])
def test_lattice_cells_against_brute_force(spark, monkeypatch, sides, pairs):
    """Dense, scattered and far cells, of negative and positive indices, settle in blocks or in the tree alike."""
    monkeypatch.setattr(neighbours, "SIDES", sides)
    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    cells = sorted({(int(i), int(j)) for i, j in np.concatenate([rng.integers(-6, 9, (150, 2)), rng.integers(-400, 400, (60, 2)), [[9000, -9000], [9001, -9000], [2000, 2000]]])})
    frame = spark.createDataFrame([(f"{i}_{j}", i, j) for i, j in cells], "grid_cell_id string, cell_i long, cell_j long")
    got = sorted((r.src, r.place, r.dst, r.dist) for r in neighbours.cell_graph(frame, 6).collect())
    expected = []
    for i, j in cells:
        order = sorted((float((i - a) ** 2 + (j - b) ** 2), f"{a}_{b}") for a, b in cells if (a, b) != (i, j))[:6]
        expected += [(f"{i}_{j}", place, dst, dist) for place, (dist, dst) in enumerate(order, 1)]
    assert got == sorted(expected)


def test_cells_of_a_narrow_band_are_not_searched_by_tree(spark, monkeypatch):
    """20,000 cells of 20 rows settle in blocks alone; the tree's leaves are long there, and a cell meets hundreds of them."""
    monkeypatch.setattr(neighbours, "nearest", lambda *_, **__: pytest.fail("searched by tree"))
    band = spark.range(20_000).select((F.col("id") % 20).alias("cell_i"), (2 * F.floor(F.col("id") / 20)).alias("cell_j"))
    found = neighbours.cell_graph(band.select(F.concat_ws("_", "cell_i", "cell_j").alias("grid_cell_id"), "cell_i", "cell_j"))
    assert found.count() == 6 * 20_000 and found.agg(F.max("dist")).first()[0] <= 13


def test_a_cell_without_coordinates_stays(spark):
    cells = spark.createDataFrame([("", None, None), ("0_0", 0, 0), ("0_1", 0, 1)], "grid_cell_id string, cell_i long, cell_j long")
    assert sorted((r.src, r.dst) for r in neighbours.cell_graph(cells, 2).collect()) == [("", "0_0"), ("", "0_1"), ("0_0", ""), ("0_0", "0_1"), ("0_1", ""), ("0_1", "0_0")]
