import re

import numpy as np

from kerbflow.llm import decontaminate as decon
from kerbflow.session import materialise


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def verdicts(documents, items, size):
    out = []
    for doc_id, text in documents:
        own, hit, named = words(text), set(), set()
        for item_id, test in items:
            test = words(test)
            n = min(size, len(test))
            for s in range(len(test) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == test[s : s + n]:
                        hit.update(range(i, i + n))
                        named |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id if doc_id is not None else -1, len(own), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out)


def cases():
    rng = np.random.default_rng(6)
    pool = [f"t{i}" for i in range(12)] + ["É", "9x"]
    items = [(i, " ".join(rng.choice(pool, int(rng.integers(1, 12))))) for i in range(12)] + [(50, None), (51, "..."), (52, "t1"), (None, "t2 t3"), (3, "t4 t5 t6"), (60, "never seen words")]
    documents = [(i, " ".join(rng.choice(pool, int(rng.integers(0, 60))))) for i in range(60)] + [(100, None), (101, " - "), (102, "T1, t1;t1 "), (None, "t2-T3"), (5, "t1"), (5, "t1")]
    documents += [(200 + i, "a b " * 30 + (items[i][1] or "") + " tail") for i in range(12)]
    return documents, items


def test_against_brute_force(spark, monkeypatch):
    documents, items = cases()
    d = spark.createDataFrame([(*r, 1) for r in documents], "doc_id long, text string, words int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, terms string")
    for shard, block in ((1 << 22, 1 << 20), (200, 20)):
        monkeypatch.setattr(decon, "SHARD_BYTES", shard)
        monkeypatch.setattr(decon, "BLOCK_WORDS", block)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decon.decontaminate(d, b, size=5).collect())
        assert got == verdicts(documents, items, 5)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [r.n_hit for r in decon.decontaminate(d, b.limit(0)).collect()] == [0]
    assert decon.decontaminate(d.limit(0), b).collect() == []


def test_proximity_against_brute_force(spark):
    documents, items = cases()
    d = spark.createDataFrame(documents, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    index = materialise(decon.build_index(d), "test-index")
    (tests,) = decon.item_blocks(b)
    decon.term_counts(index, tests)
    names = {}
    for text in [t for _, t in documents + items if t]:
        for w in words(text):
            data = np.frombuffer(w.encode(), np.uint8)
            names[w] = int(decon.hash_words(data, np.array([0]), np.array([len(data)]))[0])
    code = {h: i for i, h in enumerate(tests.vocabulary.tolist())}
    expected = []
    for item in range(len(tests.ids)):
        own = tests.words[tests.offsets[item] : tests.offsets[item + 1]]
        for s in range(0, len(own), 5):
            group = sorted(set(own[s : s + 5].tolist()), key=lambda t: (tests.counts[t], t))[:3]
            if len(group) < 3 or any(tests.counts[t] == 0 for t in group):
                continue
            for doc_id, text in documents:
                line = [code.get(names[w], -1) for w in words(text)]
                for i, t in enumerate(line):
                    if t == group[0]:
                        far = [min((abs(i - j) for j, u in enumerate(line) if u == g), default=10**6) for g in group[1:]]
                        if max(far) <= 6:
                            expected.append((doc_id or -1, tests.ids[item], i, max(far)))
    got = [(r.doc_id or -1, r.item_id, r.first, r.end) for r in decon.proximity_matches(index, tests, size=5, terms=3, reach=6).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and got


def test_windows_of_short_and_long_items():
    items = decon.Items([1, 2], [np.arange(3), np.arange(10, 20)])
    starts, lengths = items.windows(5)
    assert starts.tolist() == [0, 3, 4, 5, 6, 7, 8] and lengths.tolist() == [3] + [5] * 6
