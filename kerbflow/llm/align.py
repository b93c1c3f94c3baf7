"""Alignment of two tokenizations of the same texts by merge-path partitioning.

Tokenizer A reads a space and the text, tokenizer B the text before which it sets a space itself; the tokens of both
then spell the same bytes. The sorted token ends of A and B are merged along the merge path: binary searches on
diagonals cut the path into pieces of equal work, whatever the lengths of the texts. Pieces are independent rows, so a
very long text is spread over tasks. A piece finds the ends that A and B share; between two of them lies a group of
overlapping tokens. What stands before a piece's first and after its last shared end is stitched to its neighbours.

1. Texts are encoded once. A text whose path fits in one piece is finished at once; others are stored as pieces.
2. Pieces are cut into closed groups and open edges; a fold over a text's pieces, which come sorted, joins the edges
   and digests the groups. It keeps one open group and the text's distinct pairs.
3. Linked id pairs are counted by document: tasks count their slices, Spark adds up, the counts become sorted arrays
   in the shared folder, and workers map them to look up every document's links.

Defined cases: null and empty texts, and texts that a tokenizer does not spell byte by byte (for instance with the
mark that B writes for a space), have no tokens: zeros and an empty digest; strings of special tokens are plain text;
repeated rows are aligned and counted each; texts of any length are aligned whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import list_array, list_values, slices
from kerbflow.llm.ngram_lm import open_array, save_array, summed
from kerbflow.session import materialise, shared_path

PIECE = 1 << 16  # token ends of both sides in a piece
LARGE_GROUP = 1 << 12  # pairs of a group beyond which distinct ids are paired instead of occurrences
# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"
_LOADED: dict[tuple[str, str], tuple] = {}
_MARKED: list[str] = []  # "id," "id|" "id;" by id


# Tokenizers ------------------------------------------------------------------------------------------------------

def byte_of_symbol() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write for them: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_byte_level(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder of a byte-level BPE file and the bytes of every id."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    symbols = byte_of_symbol()
    ranks = {bytes(symbols[c] for c in token): number for token, number in vocabulary.items() if all(c in symbols for c in token)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        table[number] = token
    encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, table


def load_pieces(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder of a piece model and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(model.get_piece_size())]
    return lambda text: model.encode(text, num_threads=1), table


def _loaded(kind: str, path: str) -> tuple[Callable[[str], list[int]], list[bytes], np.ndarray]:
    if (kind, path) not in _LOADED:
        encode, table = (load_byte_level if kind == "byte" else load_pieces)(path)
        _LOADED[kind, path] = (encode, table, np.array(list(map(len, table)), dtype=np.int64))
    return _LOADED[kind, path]


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers, readable under this path on every worker."""

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends of A's and B's tokens; none where either side spells other bytes than a space and the text."""
        none = (np.zeros(0, np.int64),) * 4
        if not text:
            return none
        whole, out = (" " + text).encode(), []
        for kind, path, given in (("byte", self.byte_level, " " + text), ("pieces", self.pieces, text)):
            encode, table, lengths = _loaded(kind, path)
            ids = encode(given)
            if b"".join([table[i] for i in ids]) != whole:
                return none
            ids = np.array(ids, dtype=np.int64)
            out += [ids, np.cumsum(lengths[ids])]
        return tuple(out)


# Merge path ------------------------------------------------------------------------------------------------------

def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of both sorted sides (n + 1 each) along the merge path, ``piece`` ends apart.

    On each diagonal a binary search finds how many ends of ``a`` stand among the first ``diagonal`` merged ones
    (an end of ``a`` before an equal one of ``b``); all diagonals are searched at once. A cut that would part two
    equal ends moves behind the second.
    """
    diagonal = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        i, j = np.minimum(middle, max(len(a) - 1, 0)), np.clip(diagonal - middle - 1, 0, max(len(b) - 1, 0))
        earlier = a[i] <= b[j]  # then this end of a belongs to the diagonal's first part
        low, high = np.where(open_ & earlier, middle + 1, low), np.where(open_ & ~earlier, middle, high)
    i, j = low, diagonal - low
    inner = (i > 0) & (j < len(b))
    j = j + (inner & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, max(len(b) - 1, 0))]) if len(b) and len(a) else 0)
    return np.append(i, len(a)), np.append(j, len(b))


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of a and b up to each end that both sides share."""
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    hit = np.flatnonzero(b[place] == a) if len(b) else np.zeros(0, np.int64)
    return hit + 1, place[hit] + 1


def groups_text(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
    """``a1,a2|b1;...`` of the groups between consecutive cuts, which cover both sides from i[0] and j[0] on.

    Every token's place in the line and the mark behind it follow from the cuts; a table holds each id with each mark.
    """
    a, b, i, j = a[i[0] : i[-1]], b[j[0] : j[-1]], i - i[0], j - j[0]
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[i[1:] - 1], mark_b[j[1:] - 1] = 1, 2
    codes[np.arange(len(a)) + np.repeat(j[:-1], np.diff(i))] = 3 * a + mark_a
    codes[np.arange(len(b)) + np.repeat(i[1:], np.diff(j))] = 3 * b + mark_b
    for number in range(len(_MARKED) // 3, 1 + (int(codes.max()) // 3 if len(codes) else -1)):
        _MARKED.extend((f"{number},", f"{number}|", f"{number};"))
    return "".join(map(_MARKED.__getitem__, codes.tolist()))[:-1]


def group_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (a * width + b) of the groups between cuts, and how often each is linked."""
    m, n = np.diff(i), np.diff(j)
    large = np.flatnonzero(m * n > LARGE_GROUP)
    found = []
    for g in large:
        left, times = np.unique(a[i[g] : i[g + 1]], return_counts=True)
        right, again = np.unique(b[j[g] : j[g + 1]], return_counts=True)
        for first in range(0, len(left), max(1, (1 << 22) // len(right))):
            part = slice(first, first + max(1, (1 << 22) // len(right)))
            found.append(summed((left[part, None] * width + right).ravel(), (times[part, None] * again).ravel()))
    small = np.flatnonzero(m * n <= LARGE_GROUP)
    links = m[small] * n[small]
    group = np.repeat(small, links)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    keys = a[i[group] + inside // n[group]] * width + b[j[group] + inside % n[group]]
    found.append(summed(keys, np.ones(len(keys), dtype=np.int64)))
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])) if len(found) > 1 else found[0]


class Fold:
    """Groups of one text, from its pieces in order; an open group waits for the next shared end."""

    def __init__(self, width: int):
        self.width, self.digest, self.n_a, self.n_b, self.n_groups = width, hashlib.sha256(), 0, 0, 0
        self.open_a, self.open_b, self.keys, self.counts = [], [], [], []

    def add(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> None:
        self.n_a, self.n_b = self.n_a + len(a), self.n_b + len(b)
        i, j = shared_ends(a_ends, b_ends)
        if not len(i):
            self.open_a.append(a)
            self.open_b.append(b)
            return
        if self.open_a:  # the left edge joins what earlier pieces left open
            head_a, head_b = np.concatenate([*self.open_a, a[: i[0]]]), np.concatenate([*self.open_b, b[: j[0]]])
            self._close(head_a, head_b, np.array([0, len(head_a)]), np.array([0, len(head_b)]))
        else:
            i, j = np.append(0, i), np.append(0, j)
        if len(i) > 1:
            self._close(a, b, i, j)
        left_a, left_b = a[i[-1] :], b[j[-1] :]
        self.open_a, self.open_b = ([left_a], [left_b]) if len(left_a) or len(left_b) else ([], [])

    def _close(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        if self.n_groups:
            self.digest.update(b";")
        self.n_groups += len(i) - 1
        self.digest.update(groups_text(a, b, i, j).encode())
        keys, counts = group_pairs(a, b, i, j, self.width)
        self.keys.append(keys)
        self.counts.append(counts)
        if len(self.keys) > 16:
            keys, counts = self.pairs()
            self.keys, self.counts = [keys], [counts]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return summed(np.concatenate(self.keys), np.concatenate(self.counts)) if len(self.keys) > 1 else (self.keys[0], self.counts[0])

    def row(self) -> tuple:
        keys, counts = self.pairs()
        return self.n_a, self.n_b, self.n_groups, self.digest.hexdigest() if self.n_groups else "", keys, counts


# Spark -----------------------------------------------------------------------------------------------------------

_DONE = ["n_a", "n_b", "n_groups", "groups_sha256", "keys", "times"]
_PIECE = ["a", "a_ends", "b", "b_ends"]
_DONE_TYPES = "n_a long, n_b long, n_groups long, groups_sha256 string, keys array<long>, times array<long>"


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    return list_array(np.concatenate(values) if values else np.zeros(0, np.int64), offsets, pa.int64())


def _done_arrays(rows: list[tuple]) -> list[pa.Array]:
    n_a, n_b, n_groups, digests, keys, times = zip(*rows) if rows else ((),) * 6
    return [*(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), _lists(list(keys)), _lists(list(times))]


def _encoded(tokenizers: Tokenizers, width: int, piece: int):
    """Finished rows of texts on one piece; pieces, numbered from 0, of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, names = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            for first, last in slices(batch.column("text")):
                ids, done = [], []
                for row in range(first, last):
                    a, a_ends, b, b_ends = tokenizers.encode(batch.column("text")[row].as_py())
                    i, j = diagonal_cuts(a_ends, b_ends, piece)
                    if len(i) <= 2:
                        fold = Fold(width)
                        fold.add(a, a_ends, b, b_ends)
                        ids.append(numbers[row])
                        done.append(fold.row())
                        continue
                    for p in range(len(i) - 1):
                        of_a, of_b = slice(i[p], i[p + 1]), slice(j[p], j[p + 1])
                        yield _batch([numbers[row]], [names[row]], [p], [_lists([v]) for v in (a[of_a], a_ends[of_a], b[of_b], b_ends[of_b])], None)
                if ids:
                    yield _batch(ids, [None] * len(ids), [None] * len(ids), None, done)
    return run


def _batch(ids: list, rows: list, pieces: list, part: list[pa.Array] | None, done: list[tuple] | None) -> pa.RecordBatch:
    size = len(ids)
    part = part or [pa.nulls(size, pa.list_(pa.int64()))] * 4
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2
    finished = [pa.nulls(size, k) for k in kinds] if done is None else _done_arrays(done)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.string()), pa.array(pieces, pa.int32()), *part, *finished], ["id", "row", "piece", *_PIECE, *_DONE])


def _stitched(width: int):
    """One finished row of each text from its pieces, which come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, fold = None, None, None
        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            for k in range(batch.num_rows):
                if rows[k] != current:
                    if fold is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *_done_arrays([fold.row()])], ["id", *_DONE])
                    current, number, fold = rows[k], ids[k], Fold(width)
                fold.add(*(np.asarray(batch.column(c)[k].values) for c in _PIECE))
        if fold is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *_done_arrays([fold.row()])], ["id", *_DONE])
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and in how many of the task's documents they are linked; a bounded number waits to be sent."""
    keys, counts, waiting = [], [], 0

    def flushed() -> pa.RecordBatch:
        pairs, documents = summed(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(documents)], ["key", "documents"])

    for batch in batches:
        values, _ = list_values(batch.column("keys"))
        k, c = summed(np.asarray(values, dtype=np.int64), np.ones(len(values), dtype=np.int64))
        keys, counts, waiting = [*keys, k], [*counts, c], waiting + len(k)
        if waiting > 1 << 21:
            yield flushed()
            keys, counts, waiting = [], [], 0
    if waiting:
        yield flushed()


def _saved(root: str):
    """Sorted arrays of a key range: keys, documents, and whether that is the most of the pair's A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(batch.column(c)) for c in ("key", "documents", "best")] for batch in batches if batch.num_rows]
        if held:
            keys, documents, best = (np.concatenate(c) for c in zip(*held))
            names = [save_array(root, name, values) for name, values in (("keys", keys.astype(np.int64)), ("documents", documents.astype(np.int64)), ("best", best.astype(np.uint8)))]
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), *(pa.array([n]) for n in names)], ["first", "keys", "documents", "best"])
    return run


def _looked_up(root: str, shards: list[tuple]):
    firsts = np.array([s[0] for s in shards], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, offsets = list_values(batch.column("keys"))
            times, _ = list_values(batch.column("times"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            documents, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            shard = np.searchsorted(firsts, keys, side="right") - 1
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                known, count, top = (open_array(root, name) for name in shards[s][1:])
                place = np.searchsorted(known, keys[mine])
                documents[mine], best[mine] = count[place], top[place] > 0
            sums = []
            for weight in (times, times * best, times * documents):
                total = np.zeros(batch.num_rows, dtype=np.int64)
                np.add.at(total, owner, weight)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "groups_sha256")), *sums], ["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])
    return run


def align(documents: DataFrame, tokenizers: Tokenizers = Tokenizers(), id_column: str = "doc_id", text_column: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) of every text."""
    spark = documents.sparkSession
    width = len(_loaded("pieces", tokenizers.pieces)[1])
    # Rows may be equal, so each has a name that tells its pieces apart; they are stored before they are read.
    named = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.expr("uuid()").alias("row"))
    piece_types = "id long, row string, piece int, " + ", ".join(f"{c} array<long>" for c in _PIECE)
    encoded = materialise(named.mapInArrow(_encoded(tokenizers, width, piece), f"{piece_types}, {_DONE_TYPES}"), "align-encoded")
    pieces = encoded.where("piece IS NOT NULL").select("id", "row", "piece", *_PIECE).repartition("row").sortWithinPartitions("row", "piece")
    stitched = materialise(pieces.mapInArrow(_stitched(width), f"id long, {_DONE_TYPES}"), "align-stitched")
    done = encoded.where("piece IS NULL").select("id", *_DONE).unionByName(stitched)

    pairs = done.select("keys").mapInArrow(_counted, "key long, documents long").groupBy("key").agg(F.sum("documents").alias("documents"))
    pairs = materialise(pairs, "align-pairs")
    most = pairs.groupBy(F.expr(f"key div {width}").alias("a")).agg(F.max("documents").alias("most"))
    marked = pairs.withColumn("a", F.expr(f"key div {width}")).join(most, "a").select("key", "documents", (F.col("documents") == F.col("most")).cast("byte").alias("best"))
    root = shared_path(spark, "align-counts")
    saved = materialise(marked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_saved(root), "first long, keys string, documents string, best string"), "align-shards")
    shards = [tuple(r) for r in saved.orderBy("first").collect()]  # one row a shard
    return done.mapInArrow(_looked_up(root, shards), "id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
