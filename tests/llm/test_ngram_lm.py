import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kerbflow.llm import ngram_lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        lines = [tokens(t) for t in texts]
        self.words = Counter(w for line in lines for w in line)
        self.pairs = Counter(p for line in lines for p in zip(["\0begin", *line], line))
        self.before = Counter(w for _, w in self.pairs)
        self.after, self.total = {}, Counter()
        for (u, w), n in self.pairs.items():
            self.after.setdefault(u, []).append(n)
            self.total[u] += n
        tell = lambda values: ngram_lm.discounts(np.array([sum(v == i for v in values) for i in range(1, 5)], float))
        self.d2, self.d1 = tell(self.pairs.values()), tell(self.before.values())

    def single(self, w):
        types = len(self.pairs)
        spare = sum(self.d1[min(n, 3)] for n in self.before.values()) / types if types else 1.0
        n = self.before[w]
        return (max(n - self.d1[min(n, 3)], 0) / types if n else 0) + spare / (len(self.words) + 1)

    def pair(self, u, w):
        if not self.total[u]:
            return self.single(w)
        n = self.pairs[u, w]
        left = sum(self.d2[min(m, 3)] for m in self.after[u]) / self.total[u]
        return max(n - self.d2[min(n, 3)], 0) / self.total[u] + left * self.single(w)

    def row(self, text):
        line, total = tokens(text), sum(self.words.values())
        base = sum(math.log10((self.words[w] + 1) / (total + len(self.words) + 1)) for w in line)
        return len(line), sum(self.words[w] > 0 for w in line), total, base, sum(math.log10(self.pair(u, w)) for u, w in zip(["\0begin", *line], line))


def sample():
    rng = np.random.default_rng(5)
    pool = [f"w{int(x)}" for x in rng.zipf(1.5, 3000) if x < 400]
    texts = [" ".join(rng.choice(pool, int(rng.integers(1, 40)))) for _ in range(150)] + ["the the the THE the", "", None, "É \t\n x"]
    return texts, ["w1 w2 unseen w3", "brand new words", None, "", "the the", "the É x " * 3000] + texts[:20]


@pytest.mark.parametrize(("parts", "small"), [(8, False), (3, True)])
def test_scores_against_dictionaries(spark, monkeypatch, parts, small):
    if small:
        monkeypatch.setattr(ngram_lm, "SLICE", 300)
        monkeypatch.setattr(ngram_lm, "FLUSH", 200)
    train, others = sample()
    plain = Plain(train)
    model = ngram_lm.fit(spark.createDataFrame([(t, 1) for t in train], "text string, part int"), parts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(others)], "doc_id long, text string, keys string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(df, model).collect()}
    for i, text in enumerate(others):
        expected = plain.row(text)
        assert got[i][:3] == expected[:3]
        assert got[i][3:] == pytest.approx(expected[3:], rel=1e-9)
    # Probabilities after any context sum to one over the words and one unknown word.
    for u in ("the", "w1", "\0begin"):
        assert sum(plain.pair(u, w) for w in plain.words) + plain.pair(u, "never") == pytest.approx(1.0)


def test_no_training_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngram_lm.fit(df.limit(0).select("text"), 4)
    row = ngram_lm.score(df, model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert ngram_lm.score(df.limit(0), model).collect() == []


def test_end_marks_close_every_text():
    hashes, offsets = ngram_lm.token_hashes(pa.array(["a b", None, ""]))
    assert offsets.tolist() == [0, 3, 4, 5] and (hashes[[2, 3, 4]] == ngram_lm.END).all()


def test_counts_beyond_32_bits():
    large = np.array([5_000_000_000, 3], dtype=np.int64)
    assert ngram_lm.narrow(large).dtype == np.uint64 and ngram_lm.narrow(large // 2).dtype == np.uint32
    keys, bounds = np.array([4, 9], dtype=np.int64), np.array([0], dtype=np.int64)
    blocks = [ngram_lm._blocks(keys, ngram_lm.narrow(large), bounds), ngram_lm._blocks(keys, ngram_lm.narrow(large % 100), bounds)]
    (part, found, sums), = ngram_lm._parts(iter(blocks), np.dtype(np.int64))
    assert part == 0 and found.tolist() == [4, 9] and sums.tolist() == [5_000_000_000, 6]
    columns = np.stack([large, large + 1], axis=1)
    (_, _, sums), = ngram_lm._parts(iter([ngram_lm._blocks(keys, ngram_lm.narrow(columns), bounds)] * 2), np.dtype(np.int64), 2)
    assert sums.tolist() == (2 * columns).tolist()
    with pytest.raises(OverflowError):
        ngram_lm.check_numbers(1 << 31)
