import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from kerbflow.llm import chat

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "[ROLE:x] ", "[/ROLE]", " ", "é", "ok\n", "s>", "/s>"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b"]), PIECES), max_size=5))
def test_assembled_turns_read_back(turns):
    import pyarrow as pa

    out, offsets, begin, end = chat.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    assert chat.parse(out.tobytes().decode()) == turns
    assert [chat.unescape(out[b:e].tobytes().decode()) for b, e in zip(begin, end)] == [t for _, t in turns]


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_against_plain_python(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>"), (2, 1, "assistant", None), (2, 0, None, "é"), (None, 0, "user", "x"),
            (3, 0, "tool", "a"), (3, 0, "tool", "a"), (3, None, "user", "")] + [(4, i, ("user", "assistant")[i % 2], f"t{i}" * (i % 7)) for i in range(3000)]
    df = spark.createDataFrame([(*r, "spare") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_turns(df)).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(df)).collect() == []
