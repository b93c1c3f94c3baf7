import re

import numpy as np
import pyarrow as pa
import xxhash

from kerbflow.llm import graph, simhash


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in values) > len(values))


def closure(items, near):
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(i):
                if near(items[i], items[j]) and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    return label


def test_bit_sliced_links_against_popcount(monkeypatch):
    monkeypatch.setattr(simhash, "TASKS_AT_ONCE", 50)
    rng = np.random.default_rng(2)
    for radius in (0, 3, 4, 9, 11):
        base = rng.integers(0, 2**63, 12).astype(np.uint64)
        fp = np.concatenate([base[i] ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 14)), replace=False)) for _ in range(n)], dtype=np.uint64) for i, n in enumerate([1, 2, 3, 63, 64, 65, 130, 1, 5, 1, 1, 200])])
        group = np.repeat(np.arange(12), [1, 2, 3, 63, 64, 65, 130, 1, 5, 1, 1, 200])
        a, b = simhash.bucket_links(group, fp, radius)
        expected = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == expected and len(a) == len(expected)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(4)
    rows = [(100 + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "a b c", "A  b\tc", "É b c d e", "x " * 400])]
    for g in range(6):
        words = list(rng.choice([f"w{i}" for i in range(500)], 300))
        for k in range(1 if g == 0 else 25 if g == 1 else 4):
            copy = list(words)
            for _ in range(k % 5):
                copy[int(rng.integers(300))] = "zz"
            rows.append((1000 * g + 7 * k, " ".join(copy)))
    rows.append(rows[0])
    fps = [plain_fingerprint(t) for _, t in rows]
    label = closure(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    expected = sorted((i, f"{f:016x}", min(rows[j][0] for j in range(len(rows)) if label[j] == label[k])) for k, ((i, _), f) in enumerate(zip(rows, fps)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(df)
    got = sorted(tuple(r) for r in found.select("doc_id", simhash.fingerprint_text(found.fp), "component_id").collect())
    assert got == expected


def test_keys_meet_within_the_radius(spark):
    rng = np.random.default_rng(8)
    pairs = []
    for radius in (4, 9, 11):
        for _ in range(60):
            x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
            pairs.append((radius, x, x ^ sum(1 << int(b) for b in rng.choice(64, radius, replace=False))))
    signed = lambda x: x - 2**64 if x >> 63 else x
    for radius in (4, 9, 11):
        both = spark.createDataFrame([(i, s, signed(x)) for i, (r, *xy) in enumerate(pairs) if r == radius for s, x in enumerate(xy)], "i int, side int, fp long")
        met = both.select("i", "side", simhash.keys(radius).alias("k")).selectExpr("i", "side", "explode(k) k").distinct().groupBy("i", "k").count().where("count = 2").select("i").distinct().count()
        assert met == 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(500, 900)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    rows = graph.components(df).collect()
    assert len(rows) == 201 + 401
    assert len({r.label for r in rows if r.node <= 200}) == 1 and len({r.label for r in rows if r.node > 200}) == 1
    assert graph.components(df.limit(0)).collect() == []


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_distinct_shingles():
    hashes, offsets = simhash.shingle_hashes(pa.array(["a b a b a b", None, "q"]), 2)
    values, bounds = simhash.distinct_in_texts(hashes, offsets)
    assert np.diff(offsets).tolist() == [5, 0, 1] and np.diff(bounds).tolist() == [2, 0, 1]
    assert (np.sort(values[:2]) == values[:2]).all()
