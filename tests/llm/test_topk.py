import numpy as np
from pyspark.sql import functions as F

from kerbflow.llm import topk


def brute(rows, every, k):
    ints = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = [int(np.floor(256 * np.float64(x))) for x in v]
    out = []
    for q in ints:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 450)] + [(450, None), (451, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (452, [float("nan")] * 6), (460, [1.0, 2.0]), (470, [])]
    df = spark.createDataFrame([(*r, "spare") for r in rows + rows[:5]], "vec_id long, embedding array<float>, vector string")
    got = topk.search(df, F.col("vec_id") % 10 == 0, k=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 10, 4)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    queries, vectors = rng.integers(-50, 50, (5, 7)), rng.integers(-60, 90, (40, 7))
    lower, upper = topk.bounds(queries.astype(float), ((vectors + 60) // 6).astype(float), -60.0, 6.0)
    exact = queries @ vectors.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") % 10 == 0).collect() == []
