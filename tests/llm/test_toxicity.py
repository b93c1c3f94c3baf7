import tracemalloc

import numpy as np
import pyarrow as pa

from kerbflow.llm import common, toxicity
from kerbflow.llm.common import SPACED, hash_words, remainder, split_words


def test_word_hashes_depend_on_the_word_alone():
    texts = ["Foo bar", None, "", "  bar\tFOO é" + "x" * 50, "é"]
    data, starts, ends, offsets = split_words(pa.array(texts), SPACED)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == ["foo", "bar", "bar", "foo", "é" + "x" * 50, "é"]
    assert offsets.tolist() == [0, 2, 2, 2, 5, 6]
    hashes = hash_words(data, starts, ends)
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4


def small_model(seed=3):
    rng = np.random.default_rng(seed)
    settings = toxicity.Settings(epochs=1, min_texts=1)
    texts = [(rng.integers(1, 40, n).astype(np.uint64), rng.integers(1, 9, n).astype(np.uint64)) for n in (3, 1, 50, 7)]
    return toxicity.train(texts, np.array([0, 1, 0, 1], np.float32), settings), texts


def test_pooling_against_plain_loops(monkeypatch):
    model, texts = small_model()
    texts = [*texts[:2], (np.zeros(0, np.uint64),) * 2, *texts[2:]]
    monkeypatch.setattr(toxicity, "TOKENS_AT_ONCE", 8)
    offsets = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
    got = toxicity.pooled(model, np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]), offsets)
    for i, (words, prefixes) in enumerate(texts):
        x = [model.word_rows[toxicity._rows(model.words, words[j : j + 1])[0]] + model.prefix_rows[toxicity._rows(model.prefixes, prefixes[j : j + 1])[0]] for j in range(len(words))]
        expected = []
        for kernel, bias in zip(model.kernels, model.biases):
            responses = [np.maximum(sum((x[t + j] @ kernel[j] for j in range(len(kernel)) if t + j < len(x)), bias), 0) for t in range(len(x))]
            expected.append(np.max(responses, axis=0) if responses else np.zeros(len(bias)))
        assert np.allclose(got[i], np.concatenate(expected), atol=1e-5)


def test_learns_and_handles_odd_rows(spark):
    rng = np.random.default_rng(0)
    pool = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        words = list(rng.choice(pool, 30))
        if i % 4 == 0:
            words[int(rng.integers(30))] = f"nasty{i % 3}"
        docs.append((i, " ".join(words), "en" if i % 2 else None, 5.0))
        labels.append((i, int(i % 4 == 0), "spare"))
    docs += [(400, None, "en", 1.0), (401, "", None, 1.0), (None, "w1 nasty1", "xx", 1.0), (402, "w3 " * 50_000 + "Nasty2!", "en", 1.0), (402, "w3", "en", 1.0)]
    labels += [(400, None, "x"), (999, 1, "x")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(documents, table, learn_from=remainder("doc_id", 4) != 2)
    rows = toxicity.score(documents, model).withColumn("out", toxicity.rejected(model)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.out == ("nasty" in (r.text or "").lower()) for r in rows)


def test_no_labels_and_empty_table(spark):
    documents = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents, none)
    assert toxicity.score(documents, model).first().score < 1e-9
    assert toxicity.score(documents.limit(0), model).collect() == []


def test_class_shares_do_not_depend_on_the_sample(spark):
    """Noisy labels: texts with the cue word are toxic half of the time, so a fair score for them is a half."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(3000):
        words = [f"w{x}" for x in rng.integers(0, 60, 12)]
        cue = i % 10 == 0
        docs.append((i, " ".join([*words, "cue"] if cue else words), "en"))
        labels.append((i, int(cue and i % 20 == 0)))
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Settings(max_rows=600))
    rows = toxicity.score(documents, model).collect()
    mean = lambda cue: np.mean([r.score for r in rows if ("cue" in r.text) == cue])
    assert mean(True) < 0.75 and mean(False) < 0.05


def test_calibration_weighs_classes():
    given, toxic = np.array([0.9, 0.9, 0.6, 0.6, 0.1]), np.array([True, False, True, False, False])
    rows = np.array([40, 5, 10, 10, 40])
    half, _ = toxicity.calibrate(given, toxic, ["en"] * 5, rows, rows * 1.0)
    rare, _ = toxicity.calibrate(given, toxic, ["en"] * 5, rows, np.where(toxic, rows, 8.0 * rows))
    assert half["en"] < 0.6 and 0.6 < rare["en"] < 0.9


def test_hashing_holds_a_slice():
    """Memory beyond the result doesn't follow the bytes of the texts; each word has the hash it has alone."""
    data = np.random.default_rng(1).integers(97, 123, 4 << 20).astype(np.uint8)
    starts = np.arange(0, len(data), 64)
    ends = starts + 60
    common._POWERS.clear()
    tracemalloc.start()
    found = hash_words(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    some = np.random.default_rng(2).integers(0, len(starts), 50)
    assert found[some].tolist() == [int(hash_words(data[starts[i] : ends[i]], np.array([0]), np.array([60]))[0]) for i in some]
    # A word longer than a slice is hashed whole.
    assert hash_words(data, np.array([0]), np.array([len(data)]))[0] != hash_words(data, np.array([0]), np.array([len(data) - 1]))[0]
