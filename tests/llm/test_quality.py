import re

import numpy as np
import pytest

from kerbflow.llm import quality

TEXTS = [
    None, "", " \n\t", "one two three", "a b c d e f g h\na b c d e f g h\n\na b c d e f g h i", "# $% & <tag> | * \x0b end\r\n# x\r\n# x",
    "mehr wörter ü ß　x", "w " * 30, "x" * 5000, " ".join(f"t{i % 11}" for i in range(200)), "l\nl \nl\nl\r\nl", "1 2 3 4 5 6 7 8 9 " * 3,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)), len(hit)


def test_counts_against_brute_force(spark):
    rows = [(i, t, "spare") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again")]
    found = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), ["doc_id"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), r.doc_id


def test_path_lengths_against_a_walk():
    rng = np.random.default_rng(3)
    settings = quality.Settings(trees=7, sample=32)
    forest = quality.grow(rng.normal(size=(224, 3)), settings)
    x = rng.normal(size=(50, 3)) * 2
    for point, value in zip(x, quality.anomaly(forest, x)):
        total = 0.0
        for t in range(7):
            node = 0
            while forest.left[t, node] != node:
                node = forest.left[t, node] if point[forest.feature[t, node]] <= forest.split[t, node] else forest.right[t, node]
            total += forest.length[t, node]
        assert value == pytest.approx(2 ** (-total / 7 / quality.expected_length(32)), abs=2e-9)
    assert quality.anomaly(forest, np.full((1, 3), 9.0))[0] > np.median(quality.anomaly(forest, x / 4))


def test_best_edge():
    assert quality.best_edge([(300, 98, 1), (500, 1, 4), (700, 1, 5)], 0.01) == (0.501, pytest.approx(0.49))
    assert quality.best_edge([(300, 98, 0)], 0.1) == (float("inf"), 0.0)


def documents(rng, n):
    """Plain texts, and every eighth one of long words full of symbols."""
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(25, 90))]
        out.append((i, " ".join(w + "#%" * 4 if i % 8 == 0 else w for w in words)))
    return out


def test_odd_documents_go(spark):
    rows = documents(np.random.default_rng(1), 640)
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i, _ in rows if i % 3], "doc_id long, quality int")
    rows += [(900, None), (901, "too short"), (902, "the same words again and again and again now " * 9), (5, rows[5][1])]
    judged = quality.judge(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int"), labels).collect()
    assert len(judged) == len(rows)
    odd = [r.kept for r in judged if r.doc_id < 900 and r.doc_id % 8 == 0]
    plain = [r.kept for r in judged if r.doc_id < 900 and r.doc_id % 8]
    assert sum(odd) <= 0.05 * len(odd) and sum(plain) >= 0.98 * len(plain)
    assert [(r.base_failed, r.kept) for r in judged if r.doc_id >= 900] == [(True, False)] * 3


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    rows = documents(np.random.default_rng(2), 20)
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()
    assert all(r.kept and not r.base_failed for r in judged)
