import numpy as np
from pyspark.sql import functions as F

from kerbflow.llm import hard_negatives


def brute(rows, every, k=5, n=3):
    ints = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = (label, [int(np.floor(256 * np.float64(x))) for x in v])
    ints = {i: r for i, r in ints.items() if sum(x * x for x in r[1]) < 1 << 53}
    out = []
    for a, (label, own) in ints.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(own, v)), c, other) for c, (other, v) in ints.items() if c != a and len(v) == len(own))
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            fit = [(c, -t) for t, c, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, r + 1, c, -s, t) for r, (c, t) in enumerate(fit[:n])]
    return sorted(out)


def mined(df, every):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in columns) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, F.col("label")).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 600)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    vector = lambda i: [float(np.float32(x)) for x in centres[i % 4] + 0.6 * rng.normal(size=12)]
    rows = [(i, vector(i), int(rng.integers(4))) for i in range(300)]
    rows += [(i, rows[20][1], i % 2) for i in range(300, 420)]  # copies under two labels, ties
    rows += [(430, None, 1), (440, [1.0, None] + [0.0] * 10, 1), (450, [float("nan")] * 12, 1), (460, [1.0, 2.0], 1), (470, [], 2), (480, vector(0), None), (490, [3e38] * 12, 1), (500, [0.0] * 12, 1), (None, vector(1), 1)]
    df = spark.createDataFrame([(*r, "spare") for r in rows + rows[:5]], "vec_id long, embedding array<float>, label int, vector string")
    expected = brute(rows, 10)
    assert expected and mined(df, 10) == expected


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    for case in range(30):
        columns = np.floor(rng.normal(size=(20, 200)) * 100)
        anchor = np.floor(rng.normal(size=20) * 100)
        alive = rng.random(200) < 0.7
        exact = anchor @ columns
        low, high = columns.min(axis=1), columns.max(axis=1)
        places, scores = hard_negatives.scan(anchor, columns, low, high, alive, hard_negatives.best_rule(5))
        assert set(np.flatnonzero(alive)[np.argsort(-exact[alive])[:5]]) <= set(places) and (scores == exact[places]).all()
        window = (int(np.quantile(exact, 0.5)), int(np.quantile(exact, 0.9)))
        places, scores = hard_negatives.scan(anchor, columns, low, high, alive, hard_negatives.window_rule([window, (5, 4)], 3))
        inside = np.flatnonzero(alive & (exact >= window[0]) & (exact <= window[1]))
        assert set(inside[np.argsort(-exact[inside])[:3]]) <= set(places)
        assert len(places) < alive.sum()


def test_empty_and_alone(spark):
    schema = "vec_id long, embedding array<float>, label long"
    assert mined(spark.createDataFrame([], schema), 10) == []
    assert mined(spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], schema), 10) == []
