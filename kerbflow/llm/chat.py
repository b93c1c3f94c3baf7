"""Chat formatting by columnar byte assembly.

Turns are range-partitioned by (conversation, turn), so a conversation with a third of all rows is spread over
many tasks. A batch is assembled at once: segment lengths and cumulative offsets give the place of every header
and text in one preallocated buffer, into which all bytes are scattered; the buffer becomes an Arrow column.

Template: ``<s>[INST] user [/INST]``, `` assistant</s>``, ``[ROLE:name] other [/ROLE]`` (name percent-encoded).
A control string inside a text gets a backslash after its first character; one that looks escaped already gets
one more, so ``unescape`` restores every text. The loss mask covers assistant texts only.

Defined cases: null text and null role are empty; equal turns are ordered by role, then text; repeated rows are
turns of their own; a null conversation id is a conversation; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import list_array, text_buffer

_TAIL = r"/?s>|/?INST\]|ROLE:|/ROLE\]"
_RAW = re.compile(rf"([<\[])(\\*)({_TAIL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAIL})")
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE:(?P<role>[^\]]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>", re.S)
SCHEMA = "conv_id long, part struct<task:int,row:long>, first_turn long, n_turns long, formatted binary, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _wrapping(role: str) -> tuple[bytes, bytes]:
    if role == "user":
        return b"<s>[INST] ", b" [/INST]"
    if role == "assistant":
        return b" ", b"</s>"
    return f"[ROLE:{quote(role, safe='')}] ".encode(), b" [/ROLE]"


def _escaped(texts: pa.Array) -> pa.Array:
    """Column with control strings escaped; only texts that hold one are touched."""
    hit = pc.match_substring_regex(texts, rf"[<\[]\\*({_TAIL})")
    if not pc.any(hit).as_py():
        return texts
    values = texts.to_pylist()
    for row in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
        values[row] = escape(values[row])
    return pa.array(values, type=pa.string())


def scatter(out: np.ndarray, places: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy ``lengths`` bytes from ``starts`` of ``data`` to ``places`` of ``out``, all segments at once."""
    total = int(lengths.sum())
    if total:
        ends = np.cumsum(lengths)
        step = np.arange(total) - np.repeat(ends - lengths, lengths)
        out[np.repeat(places, lengths) + step] = data[np.repeat(starts, lengths) + step]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, n + 1 offsets of the turns, and start and end of each turn's text."""
    coded = roles.dictionary_encode()
    kinds = np.asarray(coded.indices)
    wrapped = [_wrapping(role) for role in coded.dictionary.to_pylist()]
    data, offsets = text_buffer(_escaped(texts))
    sizes = np.diff(offsets)
    before = np.array([len(head) for head, _ in wrapped], dtype=np.int64)[kinds]
    after = np.array([len(tail) for _, tail in wrapped], dtype=np.int64)[kinds]
    turns = np.concatenate([[0], np.cumsum(before + sizes + after)])
    out = np.empty(turns[-1], dtype=np.uint8)
    for part, lengths, places in ((0, before, turns[:-1]), (1, after, turns[1:] - after)):
        pieces = [w[part] for w in wrapped]
        ends = np.cumsum([0] + [len(p) for p in pieces])
        scatter(out, places, np.frombuffer(b"".join(pieces), dtype=np.uint8), ends[:-1][kinds], lengths)
    scatter(out, turns[:-1] + before, data, offsets[:-1], sizes)
    return out, turns, turns[:-1] + before, turns[1:] - after


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, turn, role, text = (batch.column(name) for name in ("conv_id", "turn", "role", "text"))
        out, turns, begin, end = assemble(role, text)
        ids = conv.fill_null(-(2**63)).to_numpy()
        nulls = conv.is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])]))
        bounds = np.concatenate([first, [len(ids)]])
        starts = turns[first]
        masked = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
        origin = np.repeat(starts, np.diff(bounds))
        counts = np.concatenate([[0], np.cumsum(masked)])[bounds]
        kind = pa.int32()
        formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate([starts, [turns[-1]]]).astype(np.int64)), pa.py_buffer(out)])
        parts = pa.StructArray.from_arrays([pa.array(np.full(len(first), task), kind), pa.array(row + np.arange(len(first)), pa.int64())], ["task", "row"])
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first)), parts, turn.take(pa.array(first)), pa.array(np.diff(bounds), pa.int64()), formatted.cast(pa.binary()),
             list_array((begin - origin)[masked], counts, kind), list_array((end - origin)[masked], counts, kind)],
            ["conv_id", "part", "first_turn", "n_turns", "formatted", "loss_start", "loss_end"])
        row += len(first)


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted conversations from (conv_id, turn, role, text), in parts.

    A part holds consecutive turns of one conversation (all of them, but where a conversation crosses the edge of
    a task or batch); parts of a conversation follow each other in the order of ``part``. ``loss_start`` and
    ``loss_end`` are byte positions in the part.
    """
    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return clean.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(_format, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    turns, place = [], 0
    while place < len(formatted):
        found = _TURN.match(formatted, place)
        if found is None:
            raise ValueError(f"no turn at character {place}")
        kind = found.lastgroup
        role = unquote(found["role"]) if kind == "other" else kind
        turns.append((role, unescape(found[kind])))
        place = found.end()
    return turns


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests over the sorted parts; only the current conversation's state is kept."""
    names = [field.split()[0] for field in DIGEST_SCHEMA.split(", ")]
    state: list | None = None

    def done(rows):
        return pa.RecordBatch.from_pylist([dict(zip(names, (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]))) for s in rows],
                                          schema=pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))))

    for batch in batches:
        ready = []
        columns = [batch.column(name) for name in ("conv_id", "formatted", "loss_start", "loss_end")]
        for conv, data, begins, ends in zip(*(c.to_pylist() for c in columns)):
            if state is None or state[0] != conv:
                if state is not None:
                    ready.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = data.decode()
            turns = parse(text)
            state[1] += len(turns)
            state[2].update("".join(f"{role}\n{said}\n" for role, said in turns).encode())
            for begin, end in zip(begins, ends):
                said = unescape(data[begin:end].decode())
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if ready:
            yield done(ready)
    if state is not None:
        yield done([state])


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, digests of what is read back from its parts.

    A digest of a whole conversation is one sequential fold, so one task streams a conversation's parts, keeping
    only the running state.
    """
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digest, DIGEST_SCHEMA)
