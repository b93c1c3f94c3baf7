import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbflow.llm import pii, pii_examples
from kerbflow.llm.common import slices

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "+", "%", " ", "1", "23", "255", "256", "0", "é", "\n", "b.c", "@x.y", "4111 1111 1111 1111", "+1 (456) 555-2186", "1.2.3.4", "(", "_"]), max_size=14).map("".join))
def test_patterns_against_plain_search(text):
    assert pii.base_spans(text) == plain(text)


@pytest.fixture(scope="module")
def tagger():
    return pii.fit()


def best_path(e, t):
    best, back = e[0] + t[0], []
    for row in e[1:]:
        reach = best[:, None] + t
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + row
    state = int((best + t[:, 0]).argmax())
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def test_islands_give_the_best_path_of_whole_texts(tagger):
    assert tagger.reach() > 0
    rng = np.random.default_rng(3)
    pool = ["the", "Anea", "tel", "phone:", "555-123-4567", "(499)", "name", "Bo", "Chen", "x@y.z", "(at)", "(dot)", "com", "iban", "DE89", "3704", "12", "mr", "###", "plain", "words", "go", "on", "is", "token", "=", "1eb9c654e721b4f812088970e66a6345cee33dd6"]
    texts = [" ".join(rng.choice(pool, int(rng.integers(0, 60)), p=None)) for _ in range(200)] + ["", "one", "Tel"] + [" ".join(["plain"] * 30 + ["tel", "555-0100"] + ["Words"] * 30)]
    hashes, shape, _, _, offsets = pii.words_of(pa.array(texts))
    got = tagger.decode(hashes, shape, offsets)
    e = tagger.emissions(tagger.codes(hashes, shape, offsets))
    for a, b in zip(offsets[:-1], offsets[1:]):
        assert a == b or got[a:b].tolist() == best_path(e[a:b], tagger.moves)


def test_held_out_forms(tagger):
    lines = {"please ring (333) 555-0176 tomorrow": ("phone", "(333) 555-0176"), "ssn 111-22-3333 there": ("id", "111-22-3333"), "mail jim (at) corp (dot) com now": ("email", "jim (at) corp (dot) com"),
             "name: Petra Stone and": ("name", "Petra Stone"), "mobile 0151 5551234 only": ("phone", "0151 5551234")}
    for text, span in lines.items():
        base, added = pii.find(pa.array([text]), tagger)
        assert not base[0] and [(k, text[a:b]) for k, a, b in added[0]] == [span]
    quiet = ["in 1984 about 17 people met", "version 2.0.1 of page 12", "The and attion. Eriner thanea of the", 'token = "1eb9c654e721b4f8"', "at at at at at", ""]
    assert pii.find(pa.array(quiet), tagger)[1] == [[]] * len(quiet)


def test_new_values_by_kind(tagger, monkeypatch):
    """The labelled sentences with names, numbers and keys that the table doesn't hold: recall and precision by kind."""
    monkeypatch.setattr(pii_examples, "FIRST", "Greta Bruno Selma Igor Laura Felix Diego Yara Simon Ruth Oskar Elena Marta Louis Theo Vera".split())
    monkeypatch.setattr(pii_examples, "LAST", "Brandt Okafor Petit Ruiz Sato Berger Costa Wolf Adler Duval Fuchs Pena Hale Moss Stone Vidal".split())
    rows = [row for copy in range(20) for row in pii_examples.generated_rows(1, 40_000 + 37 * copy)]
    texts, _ = pii.labelled(rows)
    wanted = {(i, *m) for i, row in enumerate(rows) for m in re.findall(r"\{(\w+)\|([^}]*)\}", row)}
    got = {(i, k, texts[i].encode()[a:b].decode()) for i, spans in pii.tagged_spans(pa.array(texts), tagger).items() for k, a, b in spans}
    for kind in ("name", "id", "phone", "secret"):
        own, found = {w for w in wanted if w[1] == kind}, {g for g in got if g[1] == kind}
        assert len(own & found) >= 0.9 * len(own) and len(own & found) >= 0.9 * len(found), kind


def test_other_sentences(tagger):
    texts = ["My name is Jane Doe and", "mein name ist Karl Maier", "me llamo Juan Garcia y", 'so TOKEN = "AB13F29C04E721B4F8120889706623450CE33DD6"!! as', "my ssn is 123-45-6789."]
    added = pii.find(pa.array(texts), tagger)[1]
    assert [[(k, t[a:b]) for k, a, b in own] for t, own in zip(texts, added)] == [[("name", "Jane Doe")], [("name", "Karl Maier")], [("name", "Juan Garcia")], [("secret", texts[3][12:52])], [("id", "123-45-6789")]]
    quiet = ["ner anea is. With. Thinst hees", "nten est. Paen. Tion", "nbo es. Los de rata", "rr y ue no. Llmente. Mente", "ansh st an. Tionble. Erea", "the name of the house was Big", "commit 1eb9c654e721b4f812088970e66a6345cee33dd6 in"]
    assert pii.find(pa.array(quiet), tagger)[1] == [[]] * len(quiet)


def test_rows_and_redaction(spark, tagger):
    rows = [(1, "mail é@b a.b@c.de or +1 (456) 555-2186", 5), (2, None, 0), (3, "", 0), (4, "x " * 60_000 + "1.2.3.4", 9), (4, "no data", 7), (None, "tel 555-123-4567", 1), (5, "4" * 5000 + "." + "1" * 100_000, 1)]
    df = spark.createDataFrame([(*r, "spare") for r in rows], "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pii.scan(df, tagger).collect()}
    expected = set()
    for i, t, _ in rows:
        spans = plain(t) if t and i != 5 else []
        expected.add((i, *(sum(k == s[0] for s in spans) for k in pii.BASE_KINDS), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
    assert got == expected
    clean = {(r.doc_id, r.text[:60] if r.text else r.text, r.spans) for r in pii.redact(df, tagger).collect()}
    assert (1, "mail é@b [email] or [phone]", "spare") in clean and (None, "tel [phone]", "spare") in clean and (2, None, "spare") in clean
    assert pii.scan(df.limit(0), tagger).collect() == []


def test_long_words_keep_their_shape_and_all_edges_go():
    words = ["5" * n for n in (12, 255, 256, 257, 70_000)] + ["." * 256 + "a" + "." * 300, "a" + "@" * 256 + "b", "-" * 512, "((x))" * 100]
    raw, _ = pii.text_buffer(pa.array([" ".join(words)]))
    _, shape, starts, ends, _ = pii.words_of(pa.array([" ".join(words)]))
    texts = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert texts == [w.strip(".") for w in words]
    assert len(set(shape[:5].tolist())) == 1
    assert shape[5] == 1 << 4 and shape[6] == 1 << 4 | 1 and shape[7] == 1 << 1 and shape[8] == 1 << 4 | 1 << 3
    for text, kept in [("!!!!!!!!!!!!ab?????????????", "ab"), ("..", "."), ("...", "."), ("x", "x"), ("!a b!", None)]:
        column = pa.array([text])
        _, _, a, b, _ = pii.words_of(column)
        assert kept is None or [text[i:j] for i, j in zip(a, b)] == [kept]


def test_memory_of_a_slice_is_small():
    """What a worker holds beside its batch follows the slice, not the batch."""
    column = pa.array(["Call Anna Smith at +49 30 1234567 or write to anna@example.org, card 4111 1111 1111 1111."] * 40_000)
    tagger = pii.fit(rounds=3)
    parts = [column.slice(a, b - a) for a, b in slices(column, pii.SLICE)]
    tracemalloc.start()
    pii.find(parts[0], tagger)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 4 and peak < 120e6
