import re

import numpy as np
import pytest

import corpus_pipeline
from kerbflow.llm import pii

LANGS = ("en", "de", "fr", "es")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases; returns its path and what was planted."""
    root = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(3)
    pools = {lang: [f"{lang}{i}x" for i in range(400)] for lang in LANGS}
    items = [(i, " ".join(rng.choice(pools["en"], 30))) for i in range(5)]
    docs, labels, planted = [], [], {}

    def add(text, lang, kind):
        docs.append((len(docs), text, lang, f"src{len(docs) % 3}", len(text or "")))
        planted[len(docs) - 1] = kind

    for i in range(600):
        lang = LANGS[i % 4]
        words = list(rng.choice(pools[lang], 80))
        kind = "toxic" if i % 6 == 0 else "clean"
        if kind == "toxic":
            words[int(rng.integers(80))] = f"nasty{lang}{i % 2}"
        low = i % 5 == 0
        add(" ".join(w + "###" for w in words) if low else " ".join(words), lang, kind)
        if i % 2 == 0:
            labels.append((i, int(not low), int(kind == "toxic")))
    base = " ".join(rng.choice(pools["en"], 300))
    add(base, "en", "clean")
    for k in range(30):
        copy = base.split()
        copy[int(rng.integers(300))] = f"other{k}"
        add(" ".join(copy) if k % 3 else base, "en", "copy")
    for i in range(5):
        add(" ".join(rng.choice(pools["en"], 60)) + " " + items[i][1], "en", "benchmark")
        add(" ".join(rng.choice(pools["en"], 900)) + " " + " ".join(items[i][1].split()[:13]), "en", "clean")
    add("write to a.b@c.de or +1 (456) 555-2186 " + " ".join(rng.choice(pools["en"], 60)), "en", "private")
    add(None, "en", "clean")
    add("", "de", "copy")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, planted


def shingles(text, size=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_stages_on_planted_cases(spark, folder):
    root, planted = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, state = docs.columns, docs
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    of = lambda *kinds: {i for i, k in planted.items() if k in kinds}
    expected = [of("clean", "copy", "benchmark", "private"), None, None, None]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, expected):
        before = ids(state)
        path = f"{root}/{name}"
        stage(spark, state, root).write.parquet(path)
        state = spark.read.parquet(path)
        assert state.columns == columns, name
        after = ids(state)
        if name == "toxicity":
            assert after == wanted
        elif name == "near_copies":
            sets = {i: shingles(texts[i]) for i in before}
            group = {i: i for i in before}

            def root_of(i):
                while group[i] != i:
                    i = group[i]
                return i

            order = sorted(before)
            for x, i in enumerate(order):
                for j in order[:x]:
                    union = len(sets[i] | sets[j])
                    if (len(sets[i] & sets[j]) >= 0.8 * union) if union else True:
                        a, b = sorted((root_of(i), root_of(j)))
                        group[b] = a
            assert after == {i for i in before if root_of(i) == i}
        elif name == "decontamination":
            assert after == before - of("benchmark")
        else:
            assert after == before
            assert all(not pii.base_spans(r.text or "") for r in state.collect())
            assert all(r.n_chars == len(r.text or "") for r in state.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, state, root)
    rows = last.collect()
    assert last.columns[: len(columns)] == columns and all(r.copies > 0 and r.rate > 0 for r in rows)
    assert {r.doc_id for r in rows} <= ids(state) and len(rows) > 0.2 * state.count()


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and not [r for r in rows if folder[1][r.doc_id] in ("toxic", "benchmark")]


def test_empty_documents(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []


def test_columns_named_as_the_stages_own(spark, folder):
    root, _ = folder
    names = ["score", "__label", "bad", "n_words", "rate", "copies", "posterior", "text_key", "stay_id", "node"]
    docs = spark.read.parquet(f"{root}/documents.parquet").where("doc_id < 120").selectExpr("*", *[f"doc_id + 0.5 AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(f"{root}/clash-{name}")
        docs = spark.read.parquet(f"{root}/clash-{name}")
        kept = stage(spark, docs, root)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == r.doc_id + 0.5 for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, root)
    assert {"rate", "copies", "n_words", "document_rate", "document_copies", "document_n_words"} <= set(last.columns)
    assert all(r.document_rate == r.doc_id + 0.5 for r in last.collect())
