import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kerbflow.llm import align

FILES = align.Tokenizers()
TEXTS = [
    None, "", "hello world, hello world", " leading  spaces\n\n\ttabs", "<|endoftext|> </s> <0x41> [INST]", "a▁b is not spelled", "ä ö ü ß 这是 текст 😀 \x00 \x7f",
    "x" * 700, "Ünïcödé " * 60, "aaaa bbbb " * 90, "\n" * 50, "1234567890 " * 40, "这是一个测试。" * 40, "plain words about tokens and their ends " * 30,
]


def brute(texts):
    """Rows by plain loops, from the tokenizers' own objects."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FILES.byte_level)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=FILES.pieces)
    symbols = align.byte_of_symbol()
    rows, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(symbols[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append((0, 0, 0, ""))
            links.append(Counter())
            continue
        ends = [list(np.cumsum([len(t) for t in side])) for side in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(line.encode()).hexdigest()))
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
    counts = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(*r, sum(f.values()), sum(n for (x, y), n in f.items() if counts[x, y] == most[x]), sum(n * counts[p] for p, n in f.items())) for r, f in zip(rows, links)]


@pytest.mark.parametrize("piece,large", [(align.PIECE, align.LARGE_GROUP), (7, 3)])
def test_against_brute_force(spark, monkeypatch, piece, large):
    monkeypatch.setattr(align, "LARGE_GROUP", large)
    texts = TEXTS + TEXTS[2:9]
    df = spark.createDataFrame([(i, t, "spare", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, id long").repartition(3)
    got = {r.id: (r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in align.align(df, FILES, piece=piece).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_one_id_on_equal_rows(spark):
    df = spark.createDataFrame([(1, "two equal rows of words " * 20)] * 2, "doc_id long, text string")
    got = align.align(df, FILES, piece=16).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].count_sum == 2 * got[0].n_links


def test_cuts_are_even_and_part_no_equal_ends():
    rng = np.random.default_rng(4)
    for _ in range(200):
        last = int(rng.integers(1, 300))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(1, 80)), last)) for _ in range(2))
        piece = int(rng.integers(1, 40))
        i, j = align.diagonal_cuts(a, b, piece)
        merged = np.sort(np.concatenate([a, b]), kind="stable")
        assert i[0] == j[0] == 0 and (i[-1], j[-1]) == (len(a), len(b))
        work = np.diff(i + j)
        assert (work <= piece + 1).all() and (work[:-1] >= piece - 1).all()
        for p in range(1, len(i) - 1):
            taken = np.concatenate([a[: i[p]], b[: j[p]]])
            assert sorted(taken) == list(merged[: len(taken)]) and taken.max() < min(np.append(a[i[p] :], last + 1).min(), np.append(b[j[p] :], last + 1).min())
    assert [list(c) for c in align.diagonal_cuts(np.zeros(0, int), np.zeros(0, int), 5)] == [[0], [0]]


def test_empty(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), FILES).collect() == []
