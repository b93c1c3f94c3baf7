"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags words (email, phone, id, name, secret; begin and inside) from the word, its shape, its neighbours and the
word two places before, with
weights fitted by gradient steps on a small labelled table. Decoding is exact: a word whose score for "outside"
leads by more than any two transitions can give back is outside on the best path, so only the islands between such
words go through Viterbi, many at once in numpy. Tagged spans that overlap a pattern's span are left out.

Positions are code points, ends exclusive. Defined cases: null and empty texts have no spans; equal rows get equal
results each; an empty table gives no rows; other columns are ignored (or kept, where ``redact`` returns them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from kerbflow.llm.common import SPACED, hash_words, slices, split_words, text_buffer
from kerbflow.llm.pii_examples import EXAMPLES, generated_rows, plain_rows, quiet_rows

SLICE = 1 << 19  # bytes of text tagged at a time; a worker holds about thirty times as much
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = ("email", "phone", "id", "name", "secret")
LABELS = 1 + 2 * len(KINDS)

# Fixed patterns. The look-behind only skips places from which no match can begin, so a long run is read once.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address has one @ sign, and its local part is the run of allowed characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start; matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Byte classes are counted in fields of one integer, so one prefix sum counts all of them in every word.
_FIELD = 8
_CLASSES = {"digit": b"0123456789", "at": b"@", "dash": b"-", "dot": b".", "bracket": b"()[]", "mark": b"!\"#$%&'*+,/:;<=>?\\^_`{|}~"}
_WEIGHTS = np.zeros(256, dtype=np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _WEIGHTS[list(_members)] = 1 << (_FIELD * _i)
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_WEIGHTS[_LETTERS] = 1 << (_FIELD * len(_CLASSES))
_KINDS = np.full(256, len(_CLASSES) + 1)  # the class of each byte: those above in order, letters, none
for _i, _members in enumerate(_CLASSES.values()):
    _KINDS[list(_members)] = _i
_KINDS[_LETTERS] = len(_CLASSES)
_DIGIT_STEPS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9] + [10] * 244)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
SHAPES = 11 << 6


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape number of each word: digits (by steps), letters, @, dash, dot, bracket, capital first."""
    sums = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_WEIGHTS[raw], out=sums[1:])
    counts = sums[ends] - sums[starts]
    shape = _DIGIT_STEPS[counts & 255] << 6
    for bit, name in enumerate(("at", "dash", "dot", "bracket")):
        shape |= (((counts >> (_FIELD * list(_CLASSES).index(name))) & 255) > 0).astype(np.int64) << bit
    shape |= (counts >> (_FIELD * len(_CLASSES)) > 0).astype(np.int64) << 4
    # A field holds up to 255; longer words are counted class by class.
    for i in np.flatnonzero(ends - starts > 255).tolist():
        held = np.bincount(_KINDS[raw[starts[i] : ends[i]]], minlength=len(_CLASSES) + 2)
        shape[i] = _DIGIT_STEPS[min(int(held[0]), 255)] << 6 | sum(1 << bit for bit in range(4) if held[bit + 1]) | int(held[len(_CLASSES)] > 0) << 4
    return shape | (_UPPER[raw[starts]].astype(np.int64) << 5)


_EDGES = b".,;:!?\"'%$&*#|<>=+_~`^{}/\\"
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(_EDGES)] = True
_LOWER_CASE, _CAPITAL = 1 << 4, (1 << 4) | (1 << 5)


def words_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(word hashes, shapes, starts, ends, n + 1 offsets); punctuation at the edges of words is cut off."""
    raw, _ = text_buffer(column)
    data, starts, ends, offsets = split_words(column, SPACED)
    if len(starts):
        edged = np.flatnonzero(_EDGE[raw[starts]] | _EDGE[raw[ends - 1]])
        inner = np.append(np.flatnonzero(~_EDGE[raw]), len(raw))
        first, low, high = np.searchsorted(inner, starts[edged]), starts[edged], ends[edged]
        last = np.searchsorted(inner, high) - 1
        # A word of punctuation alone is its middle character.
        bare, middle = inner[first] >= high, low + (high - low) // 2
        starts[edged] = np.where(bare, middle, inner[first])
        ends[edged] = np.where(bare, middle, inner[last]) + 1
    return hash_words(data, starts, ends), shapes(raw, starts, ends), starts, ends, offsets


@dataclass
class Tagger:
    vocabulary: np.ndarray  # sorted hashes; row i + 1 of the word tables
    tables: dict[str, np.ndarray]  # word, before, before_two, after: (words + 1, labels); shape, shape_before, shape_after: (SHAPES, labels)
    moves: np.ndarray  # (labels, labels)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)

    def codes(self, hashes: np.ndarray, shape: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Row numbers in each table; beyond a text's edges row and shape are zero."""
        row = self.rows(hashes) if len(hashes) else np.zeros(0, np.int64)
        out = {"word": row, "shape": shape}
        first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
        for name, values in (("", row), ("shape_", shape)):
            before, after = np.zeros_like(values), np.zeros_like(values)
            before[1:], after[:-1] = values[:-1], values[1:]
            before[first] = 0
            after[last] = 0
            out[f"{name}before"], out[f"{name}after"] = before, after
        two = np.zeros_like(row)
        two[1:] = out["before"][:-1]
        two[first] = 0
        out["before_two"] = two
        return out

    def emissions(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        return sum(table[codes[name]] for name, table in self.tables.items())

    def reach(self) -> int:
        """How far from a telling word another label than outside can be best.

        Quiet words differ in capitals alone; ``lead`` bounds what a label can score there above outside. If any path of
        r labels other than outside over quiet words loses against going through outside between the same ends, the
        best path has no r such words in a row, and none at all where both ends are outside. Then words r places or
        more from the nearest telling word are outside. 0: there is no such r up to 16, all words must be decoded.
        """
        shapes_ = (_LOWER_CASE, _CAPITAL)
        lead = np.full(LABELS, -np.inf)
        for a in shapes_:
            for b in shapes_:
                for c in shapes_:
                    e = self.emissions({"word": 0, "before": 0, "before_two": 0, "after": 0, "shape_before": a, "shape": b, "shape_after": c})
                    lead = np.maximum(lead, e - e[0])
        t = self.moves
        best = t[:, 1:] + lead[1:]  # from any label through one quiet word
        outside = t[:, 0].copy()  # the same through outside
        for r in range(1, 17):
            closed = (best + t[1:, 0])[0].max() < outside[0] + t[0, 0]
            if not closed:
                return 0
            if ((best[:, :, None] + t[1:, 1:]).max(axis=1) < outside[:, None] + t[0, 1:]).all():
                return r + 1
            best = (best[:, :, None] + t[1:, 1:]).max(axis=1) + lead[1:]
            outside = outside + t[0, 0]
        return 0

    def decode(self, hashes: np.ndarray, shape: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Best label of every word of texts."""
        labels = np.zeros(len(hashes), dtype=np.int8)
        if not len(hashes):
            return labels
        codes = self.codes(hashes, shape, offsets)
        reach = self.reach()
        telling = (codes["word"] > 0) | ((shape != _LOWER_CASE) & (shape != _CAPITAL))
        if reach:
            # A word's neighbours and the second word after see it, so they are telling too; then the reach on either side.
            at = np.flatnonzero(telling)
            marks = np.zeros(len(hashes) + 1, dtype=np.int32)
            np.add.at(marks, np.maximum(at - reach - 1, 0), 1)
            np.add.at(marks, np.minimum(at + reach + 3, len(hashes)), -1)
            edge = np.zeros(len(hashes), bool)
            filled = np.diff(offsets) > 0
            edge[offsets[:-1][filled]] = edge[offsets[1:][filled] - 1] = True
            near = np.flatnonzero(edge)
            np.add.at(marks, np.maximum(near - reach - 1, 0), 1)
            np.add.at(marks, np.minimum(near + reach + 2, len(hashes)), -1)
            active = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        else:
            active = np.arange(len(hashes))
        if not len(active):
            return labels
        scores = self.emissions({k: v[active] for k, v in codes.items()})
        text = np.searchsorted(offsets, active, side="right")
        new = np.concatenate([[True], (active[1:] != active[:-1] + 1) | (text[1:] != text[:-1])])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(active)))
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        # Islands in falling order of length: the first ones are still running at any step.
        best = scores[begin] + self.moves[0]
        back = []
        for step in range(1, int(sizes[0])):
            running = int(np.searchsorted(-sizes, -step, side="left"))
            reach = best[:running, :, None] + self.moves
            back.append(reach.argmax(axis=1).astype(np.int8))
            best[:running] = reach.max(axis=1) + scores[begin[:running] + step]
        state = (best + self.moves[:, 0]).argmax(axis=1)
        for step in range(int(sizes[0]) - 1, -1, -1):
            running = int(np.searchsorted(-sizes, -step, side="left"))
            labels[active[begin[:running] + step]] = state[:running]
            if step:
                state[:running] = back[step - 1][np.arange(running), state[:running]]
        return labels


def labelled(examples: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Plain texts and word labels of the labelled table."""
    texts, labels = [], []
    for row in examples:
        text, spans, place = "", [], 0
        for m in re.finditer(r"\{(\w+)\|([^}]*)\}", row):
            text += row[place : m.start()]
            spans.append((len(text.encode()), len((text + m[2]).encode()), KINDS.index(m[1])))
            text += m[2]
            place = m.end()
        text += row[place:]
        texts.append(text)
        _, _, starts, _, _ = words_of(pa.array([text]))
        own = np.zeros(len(starts), dtype=np.int64)
        for a, b, kind in spans:
            inside = np.flatnonzero((starts >= a) & (starts < b))
            own[inside] = 2 + 2 * kind
            own[inside[:1]] = 1 + 2 * kind
        labels.append(own)
    return texts, labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(examples: list[str] | None = None, rounds: int = 200, rate: float = 0.3, shrink: float = 0.002, min_count: int = 2) -> Tagger:
    """Weights that maximise the likelihood of the labelled table (by default the given one), less a quadratic penalty."""
    texts, gold = labelled(examples or EXAMPLES + generated_rows() + quiet_rows() + plain_rows())
    hashes, shape, _, _, offsets = words_of(pa.array(texts))
    # The vocabulary holds words that mostly stand before entities, the signs that join the parts of an address, and what
    # links a cue to its value;
    # names and numbers themselves must be told by shape and company.
    tags = np.concatenate(gold)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    before = np.zeros(len(tags), dtype=bool)
    for step in (1, 2):
        before[:-step] |= (tags[:-step] == 0) & (tags[step:] > 0) & (text[:-step] == text[step:])
    known, inverse = np.unique(hashes, return_inverse=True)
    near, all_ = np.bincount(inverse, before), np.bincount(inverse)
    cues = known[(2 * near >= all_) & (near >= min_count)]
    tagger = Tagger(np.unique(np.concatenate([cues, hash_of("(at)", "(dot)", "[at]", "[dot]", "is", "ist", "est", "es", "=")])), {}, np.zeros((LABELS, LABELS)))
    v = len(tagger.vocabulary) + 1
    tagger.tables = {"word": np.zeros((v, LABELS)), "before": np.zeros((v, LABELS)), "before_two": np.zeros((v, LABELS)), "after": np.zeros((v, LABELS)),
                     "shape": np.zeros((SHAPES, LABELS)), "shape_before": np.zeros((SHAPES, LABELS)), "shape_after": np.zeros((SHAPES, LABELS))}
    codes = tagger.codes(hashes, shape, offsets)
    sizes = np.diff(offsets)
    n, longest = len(texts), int(sizes.max())
    grid = offsets[:-1, None] + np.arange(longest)
    live = np.arange(longest) < sizes[:, None]
    grid = np.where(live, grid, 0)
    y = np.concatenate(gold)[grid]
    total = {k: np.zeros_like(t) for k, t in tagger.tables.items()} | {"moves": np.zeros_like(tagger.moves)}
    rows = np.arange(n)
    for _ in range(rounds):
        e, t = tagger.emissions(codes)[grid], tagger.moves
        forward = np.empty((longest, n, LABELS))
        backward = np.empty((longest, n, LABELS))
        forward[0] = e[:, 0] + t[0]
        for i in range(1, longest):
            forward[i] = np.where(live[:, i, None], _log_sum(forward[i - 1][:, :, None] + t, 1) + e[:, i], forward[i - 1])
        norm = _log_sum(forward[-1] + t[:, 0], 1)
        backward[-1] = t[:, 0]
        for i in range(longest - 2, -1, -1):
            backward[i] = np.where(live[:, i + 1, None], _log_sum(t + (e[:, i + 1] + backward[i + 1])[:, None, :], 2), backward[i + 1])
        slope = np.exp(forward + backward - norm[:, None]).transpose(1, 0, 2)
        slope[rows[:, None], np.arange(longest), y] -= 1
        slope[~live] = 0
        flat = np.zeros((len(hashes), LABELS))
        flat[grid[live]] = slope[live]
        moves = np.zeros_like(t)
        first, last = slope[:, 0], slope[rows, sizes - 1]
        moves[0] += first.sum(axis=0)
        moves[:, 0] += last.sum(axis=0)
        for i in range(1, longest):
            on = live[:, i]
            p = np.exp(forward[i - 1][on][:, :, None] + t + (e[:, i] + backward[i])[on][:, None, :] - norm[on][:, None, None])
            moves += p.sum(axis=0)
            np.add.at(moves, (y[on, i - 1], y[on, i]), -1)
        for name, table in [*tagger.tables.items(), ("moves", tagger.moves)]:
            g = moves if name == "moves" else np.zeros_like(table)
            if name != "moves":
                np.add.at(g, codes[name], flat)
            g = g / n + shrink * table
            total[name] += g**2
            table -= rate * g / (np.sqrt(total[name]) + 1e-8)
    return tagger


def hash_of(*words: str) -> np.ndarray:
    data, starts, ends, _ = split_words(pa.array(list(words)), SPACED)
    return hash_words(data, starts, ends)


def tagged_spans(column: pa.Array, tagger: Tagger) -> dict[int, list[tuple[str, int, int]]]:
    """Byte spans (within the text) that the field tags, by row."""
    hashes, shape, starts, ends, offsets = words_of(column)
    _, begins = text_buffer(column)
    labels = tagger.decode(hashes, shape, offsets)
    at = np.flatnonzero(labels)
    out: dict[int, list[tuple[str, int, int]]] = {}
    last = (-2, -1, -1)
    for word, text in zip(at.tolist(), (np.searchsorted(offsets, at, side="right") - 1).tolist()):
        kind, inside = (int(labels[word]) - 1) // 2, int(labels[word]) % 2 == 0
        own = out.setdefault(text, [])
        if inside and last == (word - 1, text, kind) and own:
            own[-1] = (KINDS[kind], own[-1][1], int(ends[word] - begins[text]))
        else:
            own.append((KINDS[kind], int(starts[word] - begins[text]), int(ends[word] - begins[text])))
        last = (word, text, kind)
    return out


def find(column: pa.Array, tagger: Tagger) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Pattern spans and added spans of each text, in code points. Texts without digits and @ signs meet no pattern."""
    raw, offsets = text_buffer(column)
    telling = (raw >= 48) & (raw <= 57) | (raw == 64)
    counts = np.concatenate([[0], np.cumsum(telling)])[offsets]
    tagged = tagged_spans(column, tagger)
    base: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    added: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    for row in np.union1d(np.flatnonzero(np.diff(counts)), np.fromiter(tagged, dtype=np.int64, count=len(tagged))).tolist():
        data = raw[offsets[row] : offsets[row + 1]].tobytes()
        text = data.decode()
        base[row] = base_spans(text)
        for kind, a, b in tagged.get(row, ()):
            a, b = len(data[:a].decode()), len(data[:b].decode())
            if all(b <= s or e <= a for _, s, e in base[row]):
                added[row].append((kind, a, b))
    return base, added


ORDER = {kind: i for i, kind in enumerate((*BASE_KINDS, *(k for k in KINDS if k not in BASE_KINDS)))}
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ORDER[s[0]], s[1], s[2])))


def scan(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """Per row of (doc_id, text): counts of pattern spans, pattern spans and all spans as ``kind:start:end`` lists."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "spans"]
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE):
                part = batch.slice(first, last - first)
                base, added = find(part.column("text"), shared.value)
                counts = [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in BASE_KINDS]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([joined(b) for b in base], pa.string()), pa.array([joined(b + a) for b, a in zip(base, added)], pa.string())], names)

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    parts, place = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], ORDER[s[0]])):
        if a >= place:
            parts += [text[place:a], f"[{kind}]"]
        place = max(place, b)
    return "".join([*parts, text[place:]])


def redact(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """Documents with personal data in ``text`` replaced; a column n_chars follows the new text. Other columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    schema = StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType, True) for f in documents.schema])
    counted = "n_chars" in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE):
                part = batch.slice(first, last - first)
                base, added = find(part.column("text"), shared.value)
                rows = [i for i in range(len(part)) if base[i] or added[i]]
                columns = dict(zip(part.schema.names, part.columns))
                if rows:
                    texts = columns["text"].to_pylist()
                    sizes = columns["n_chars"].to_pylist() if counted else None
                    for i in rows:
                        texts[i] = redacted(texts[i], base[i] + added[i])
                        if counted:
                            sizes[i] = len(texts[i])
                    columns["text"] = pa.array(texts, pa.string())
                    if counted:
                        columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return documents.mapInArrow(run, schema)
