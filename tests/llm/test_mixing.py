import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.llm import mixing


def table(spark, n, p):
    return spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_words long, posterior array<double>")


def dense_fit(n, p, target, rounds=200_000):
    """Least squares over nonnegative rates by plain projected gradient in the scaled variables."""
    r, whole = np.ones(len(n)), n.sum()
    overlap = (p * n[:, None]).T @ p / whole
    step = 1 / np.linalg.eigvalsh(overlap).max()
    for _ in range(rounds):
        r = np.maximum(0, r - step * (p @ (((n * r) @ p) / whole - target)))
    return float(np.sum((((n * r) @ p) / whole - target) ** 2))


@pytest.mark.parametrize("target", [[0.2, 0.3, 0.5], [0.9, 0.05, 0.05], [0.0, 0.5, 0.5]])
def test_least_squares_against_a_dense_fit(spark, target):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.6, 0.9], 80)
    n = rng.integers(0, 500, 80).astype(float)
    target = np.array(target)
    mix = mixing.solve(table(spark, n, p), target)
    rates = {r.doc_id: r.rate for r in mixing.with_rates(table(spark, n, p), mix, ["doc_id"], 3).collect()}
    r = np.array([rates[i] for i in range(80)])
    assert (r >= 0).all()
    got = float(np.sum((((n * r) @ p) / n.sum() - target) ** 2))
    best = dense_fit(n, p, target, 20_000)
    assert got <= best + 2e-6
    shares = ((n * r) @ p) / n.sum()
    assert mix.residual == pytest.approx(float(np.abs(shares - target).max()), abs=1e-9)
    assert (mix.residual < 1e-6) == (best < 1e-10)


def test_classifier_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    pools = {"a": [f"apple{i}" for i in range(40)], "b": [f"birch{i}" for i in range(40)]}
    docs = [(i, " ".join(rng.choice(pools["ab"[i % 2]], 30)), "x", 0) for i in range(300)]
    odd = [(1000, None, "x", 0), (1001, "", "x", 0), (None, "apple1 apple2", "x", 0), (1002, "birch1 " * 80_000, "x", 0), (0, docs[0][1], "x", 0)]
    documents = spark.createDataFrame(docs + odd, "doc_id long, text string, source string, n_words int")
    labels = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None) for i in range(0, 200)], "doc_id long, domain string")
    model = mixing.fit(documents, labels, F.col("domain"), ("a", "b"))
    found, mix = mixing.mix_documents(documents, model, {"a": 3, "b": 1}, ["doc_id", "source"])
    rows = found.collect()
    assert len(rows) == len(docs) + len(odd) and all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    right = [(r.posterior[0] > 0.5) == (r.doc_id % 2 == 0) for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.98
    assert np.allclose(mix.totals, mix.targets, rtol=1e-6)
    total = np.sum([r.rate * r.n_words * np.array(r.posterior) for r in rows], axis=0)
    assert np.allclose(total / total.sum(), [0.75, 0.25], atol=1e-6)
    assert {r.n_words for r in rows if r.doc_id in (1000, 1001)} == {0}


def test_domain_without_labels_is_left_out(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice([f"{'apple birch cedar'.split()[i % 3]}{j}" for j in range(40)], 30))) for i in range(240)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(0, 240) if i % 3 < 2], "doc_id long, domain string")
    model = mixing.fit(documents, labels, F.col("domain"), ("a", "b", "c"))
    assert model.domains == ("a", "b")
    found, mix = mixing.mix_documents(documents, model, {"a": 3, "b": 1, "c": 4}, ["doc_id"])
    assert np.allclose(mix.totals / mix.totals.sum(), [0.75, 0.25], atol=1e-6)
    # Texts of the unknown domain stay: the fit doesn't chase a target that no text can meet.
    assert len([r for r in found.collect() if r.rate > 0]) > 200


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, domain string")
    model = mixing.fit(documents, labels, F.col("domain"), ("a", "b"))
    found, _ = mixing.mix_documents(documents, model, {"a": 1, "b": 1}, ["doc_id"])
    assert found.collect() == []


def test_copies_follow_the_rate(spark):
    df = spark.range(4000).select("id", mixing.copies(F.lit(1.3), "id").alias("n"), mixing.copies(F.lit(2.0), "id").alias("two"), mixing.copies(F.lit(0.0), "id").alias("none"))
    mean, two, none = df.agg(F.avg("n"), F.avg("two"), F.avg("none")).first()
    assert abs(mean - 1.3) < 0.05 and two == 2 and none == 0
