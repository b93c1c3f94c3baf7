"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays that workers map.

Words are numbered by the rank of their 64-bit hash; a bigram is the pair of numbers as one 64-bit key. Tasks count
slices of texts and send sorted blocks of (key, count) to key ranges; a range's blocks are merged into one sorted
array. Ranges follow the words' counts, and the range of a word with very many successors is cut by the successor.
Each shard is a file below the shared folder, which scoring tasks map into memory and search with sorted lookups, so
a worker holds no copy and the size of the model is not bounded by its memory. Only totals and file names pass
through the driver.

Files are written and read through the file system of the shared folder's URI; where that is no local path, a worker
fetches a file to its temporary folder, maps it and unlinks it at once.

Defined cases: null and empty texts are the end mark alone; words not met in training get the model's share for
unknown words; without training texts every word has probability one over one; repeated rows are scored each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import SPACED, hash_words, slices, split_words
from kerbflow.session import materialise, shared_path
from kerbflow.session import slices as shuffle_slices

END = np.uint64(0x5E4D0F7E87)  # hash of the end mark
SLICE = 1 << 22
FLUSH = 1 << 21
BLOCKS = "part int, keys binary, counts binary"
OPEN_AT_ONCE = 4096
_OPEN: dict[str, np.ndarray] = {}


# Arrays in the shared folder -------------------------------------------------------------------------------------

def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _local(uri: str) -> str:
    return uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:")


def save_array(root: str, name: str, values: np.ndarray) -> str:
    """Write an array under a fresh name, so that a repeated task leaves earlier files alone; returns its address."""
    store, folder = _store(_local(root))
    store.create_dir(folder, recursive=True)
    address = f"{folder}/{name}-{uuid.uuid4().hex[:12]}.{values.dtype.name}"
    with store.open_output_stream(address) as out:
        out.write(np.ascontiguousarray(values).data.cast("B") if values.size else b"")
    return address


@contextmanager
def array_writer(root: str, address: str) -> Iterator[pa.NativeFile]:
    """Stream to a fresh file of the shared folder."""
    store, path = _store(_local(address))
    store.create_dir(_store(_local(root))[1], recursive=True)
    with store.open_output_stream(path) as out:
        yield out


def array_part(root: str, address: str, start: int, size: int) -> np.ndarray:
    """Some values of an array written under its address: mapped where the folder is local, else read as a range."""
    store, path = _store(_local(address))
    if isinstance(store, fs.LocalFileSystem):
        return open_array(root, path)[start : start + size]
    kind = np.dtype(address.rpartition(".")[2])
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_at(size * kind.itemsize, start * kind.itemsize), dtype=kind)


def open_array(root: str, address: str) -> np.ndarray:
    """Map an array; kept open for later batches of this worker."""
    if address not in _OPEN:
        if len(_OPEN) >= OPEN_AT_ONCE:
            _OPEN.clear()
        store, _ = _store(_local(root))
        kind = np.dtype(address.rpartition(".")[2])
        path, fetched = address, not isinstance(store, fs.LocalFileSystem)
        if fetched:
            with store.open_input_stream(address) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
                path = copy.name
                while data := source.read(1 << 24):
                    copy.write(data)
        _OPEN[address] = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
        if fetched:
            os.unlink(path)
    return _OPEN[address]


# Sorted blocks ---------------------------------------------------------------------------------------------------

def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (one or more columns)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all fit, else in 64."""
    return counts.astype(np.uint32 if not counts.size or int(counts.max()) < 1 << 32 else np.uint64)


def _blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Rows of the parts that hold any of the sorted keys; ``bounds`` are the first keys of the parts."""
    edges = np.append(np.searchsorted(keys, bounds), len(keys))
    held = np.flatnonzero(np.diff(edges))
    cut = lambda values: [values[edges[p] : edges[p + 1]].tobytes() for p in held]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(cut(keys), pa.binary()), pa.array(cut(counts), pa.binary())], ["part", "keys", "counts"])


def _parts(batches: Iterator[pa.RecordBatch], kind: np.dtype, columns: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, distinct keys, summed counts) of rows sorted by part; blocks are merged as they come."""
    part, keys, counts, waiting = None, [], [], 0

    def merged():
        return summed(np.concatenate(keys), np.concatenate(counts))

    for batch in batches:
        for p, k, c in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("counts")):
            if p != part:
                if part is not None:
                    yield part, *merged()
                part, keys, counts, waiting = p, [], [], 0
            keys.append(np.frombuffer(k.as_buffer(), dtype=kind))
            size = len(keys[-1]) * columns
            own = np.frombuffer(c.as_buffer(), dtype=np.uint64 if size and len(c.as_buffer()) == 8 * size else np.uint32).astype(np.int64)
            counts.append(own.reshape(-1, columns) if columns > 1 else own)
            waiting += len(keys[-1])
            if waiting > 2 * FLUSH and len(keys) > 1:
                k0, c0 = merged()
                keys, counts, waiting = [k0], [c0], 0
    if part is not None:
        yield part, *merged()


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartition(parts, "part").sortWithinPartitions("part")


# Texts to word hashes, numbers and bigrams -----------------------------------------------------------------------

def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end mark, and n + 1 offsets."""
    data, starts, ends, offsets = split_words(column, SPACED)
    hashes = hash_words(data, starts, ends)
    out = np.full(len(hashes) + len(column), END, dtype=np.uint64)
    words = np.diff(offsets)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(column)), words)] = hashes
    return out, offsets + np.arange(len(column) + 1)


@dataclass
class Vocabulary:
    root: str
    bounds: np.ndarray  # first hash of each shard
    base: np.ndarray  # first number of each shard, and the number of words
    hashes: list[str]
    counts: list[str]
    total: int

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 where a word is not known."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        edges = np.append(np.searchsorted(hashes, self.bounds), len(hashes))
        for shard, address in enumerate(self.hashes):
            low, high = edges[shard], edges[shard + 1]
            known = open_array(self.root, address)
            if low < high and len(known):
                place = np.searchsorted(known, hashes[low:high])
                place[place == len(known)] = 0
                out[low:high] = np.where(known[place] == hashes[low:high], place + self.base[shard], -1)
        return out

    def dense(self, addresses: list[str], numbers: np.ndarray) -> np.ndarray:
        """Values of arrays that are laid out by word number, for sorted known numbers."""
        edges = np.searchsorted(numbers, self.base)
        found = [open_array(self.root, a)[numbers[low:high] - b] for a, b, low, high in zip(addresses, self.base, edges[:-1], edges[1:]) if low < high]
        return np.concatenate(found) if found else np.zeros(0)


def numbered(vocabulary: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers (-1 first, if any word is unknown) and each token's place among them."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    numbers = vocabulary.number(distinct)
    # Known words keep their order, as numbers are ranks of hashes; unknown ones all become one.
    known = numbers >= 0
    place = np.cumsum(known) - 1
    if known.all():
        return numbers, inverse
    return np.concatenate([[-1], numbers[known]]), np.where(known, place + 1, 0)[inverse]


def check_numbers(size: int) -> None:
    """Word numbers and the begin mark must fit in the halves of a bigram's key."""
    if size >= 1 << 31:
        raise OverflowError(f"{size} distinct words; a bigram's key holds numbers below {1 << 31}")


def bigram_keys(numbers: np.ndarray, offsets: np.ndarray, begin: int) -> np.ndarray:
    """(previous, own) numbers as one key; the first word of a text follows ``begin``."""
    previous = np.empty_like(numbers)
    previous[1:] = numbers[:-1]
    previous[offsets[:-1]] = begin
    return (previous << 32) | numbers


# Fit -------------------------------------------------------------------------------------------------------------

def _count_words(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE):
                k, c = np.unique(token_hashes(batch.column("text").slice(first, last - first))[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                waiting += len(k)
                if waiting > FLUSH:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    yield _blocks(k, narrow(c), bounds)
                    keys, counts, waiting = [], [], 0
        if keys:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            yield _blocks(k, narrow(c), bounds)
    return run


def fit_vocabulary(texts: DataFrame, root: str, parts: int) -> tuple[Vocabulary, list[tuple[int, int]]]:
    """Numbered words with their counts; also the words that make up a share of one in ``parts`` or more."""
    bounds = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _parts(batches, np.dtype(np.uint64)):
            top = np.argsort(-counts, kind="stable")[:parts]
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([save_array(root, f"words-{part}", keys)]), pa.array([save_array(root, f"counts-{part}", counts.astype(np.uint64))]), pa.array([len(keys)], pa.int64()),
                pa.array([int(counts.sum())], pa.int64()), pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([counts[top].tolist()], pa.list_(pa.int64()))], ["part", "hashes", "counts", "size", "total", "places", "heavy"])

    blocks = texts.select("text").mapInArrow(_count_words(bounds), BLOCKS)
    written = _dealt(blocks, parts).mapInArrow(write, "part int, hashes string, counts string, size long, total long, places array<long>, heavy array<long>")
    # One row a shard; of its most frequent words only those over the share are taken to the driver.
    rows = materialise(written, "lm-words")
    total = rows.agg(F.sum("total")).first()[0] or 0
    limit = max(1, total // parts)
    pairs = F.filter(F.arrays_zip("places", "heavy"), lambda x: x["heavy"] >= limit)
    shards = {r.part: r for r in rows.select("part", "hashes", "counts", "size", pairs.alias("top")).collect()}
    held = sorted(shards)
    base = np.concatenate([[0], np.cumsum([shards[p].size for p in held])]).astype(np.int64)
    check_numbers(int(base[-1]))
    vocabulary = Vocabulary(root, bounds[held], base, [shards[p].hashes for p in held], [shards[p].counts for p in held], int(total))
    return vocabulary, [(int(b + x["places"]), int(x["heavy"])) for p, b in zip(held, base) for x in shards[p].top]


def _count_bigrams(vocabulary: Vocabulary, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE):
                hashes, offsets = token_hashes(batch.column("text").slice(first, last - first))
                distinct, place = numbered(vocabulary, hashes)
                k, c = np.unique(bigram_keys(distinct[place], offsets, vocabulary.size), return_counts=True)
                keys.append(k)
                counts.append(c)
                waiting += len(k)
                if waiting > FLUSH:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    yield _blocks(k, narrow(c), bounds)
                    keys, counts, waiting = [], [], 0
        if keys:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            yield _blocks(k, narrow(c), bounds)
    return run


def key_bounds(vocabulary: Vocabulary, heavy: list[tuple[int, int]], parts: int) -> np.ndarray:
    """First keys of the bigram ranges: one for each shard of words, and more inside a heavy word's successors."""
    bounds = {0} | {int(b) << 32 for b in vocabulary.base[:-1]} | {vocabulary.size << 32}
    for word, count in heavy:
        pieces = -(-count * parts // max(1, vocabulary.total))
        bounds |= {(word << 32) | (i * vocabulary.size // pieces) for i in range(pieces)} | {(word + 1) << 32}
    # Texts begin with one mark, which as many words may follow as there are texts.
    bounds |= {(vocabulary.size << 32) | (i * vocabulary.size // parts) for i in range(parts)}
    return np.array(sorted(bounds), dtype=np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from the numbers of items met one to four times."""
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return np.array([0.0, *(min(max(d, 0.01), i + 0.99) for i, d in enumerate(raw))])


@dataclass
class Model:
    vocabulary: Vocabulary
    bounds: np.ndarray  # first keys of the bigram ranges that have a file
    keys: list[str]
    counts: list[str]
    contexts: list[str]  # by word number: followers met once, twice, more often, and all occurrences (four columns)
    preceders: list[str]  # by word number: distinct words before it
    begin: np.ndarray  # the same four numbers for the begin mark
    types: int
    bigram_discounts: np.ndarray
    word_discounts: np.ndarray
    spare: float  # share of the words' distribution that is spread evenly


def _write_bigrams(vocabulary: Vocabulary, root: str):
    """Write merged ranges; pass on what each range tells about contexts and successors, and counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _parts(batches, np.dtype(np.int64)):
            files = [save_array(root, f"keys-{part}", keys), save_array(root, f"bigrams-{part}", narrow(counts))]
            kinds = np.stack([counts == 1, counts == 2, counts > 2, counts], axis=1).astype(np.int64)
            contexts, told = summed(keys >> 32, kinds)
            words, before = np.unique(keys & 0xFFFFFFFF, return_counts=True)
            known = contexts < vocabulary.size
            start = told[~known].sum(axis=0)
            meta = np.array([*(int((counts == i).sum()) for i in range(1, 5)), len(keys), *start.tolist()], dtype=np.int64)
            rows = [(0, part, keys[:1].tobytes(), meta.tobytes(), files)]
            for kind, k, c in ((1, contexts[known], narrow(told[known])), (2, words, narrow(before))):
                block = _blocks(k, c, vocabulary.base[:-1])
                rows += [(kind, p, a.as_py(), b.as_py(), None) for p, a, b in zip(block.column("part").to_pylist(), block.column("keys"), block.column("counts"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string())))], ["kind", "part", "keys", "counts", "files"])
    return run


def _write_dense(vocabulary: Vocabulary, root: str, columns: int, name: str):
    """Lay the sums of a shard of words out by number; also counts of counts of single columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _parts(batches, np.dtype(np.int64), columns):
            size = int(vocabulary.base[part + 1] - vocabulary.base[part])
            values = np.zeros((size, columns), dtype=np.int64)
            values[keys - vocabulary.base[part]] = counts.reshape(-1, columns)
            ones = [int((counts == i).sum()) for i in range(1, 5)] + [int((counts > 2).sum())] if columns == 1 else [0] * 5
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([save_array(root, f"{name}-{part}", narrow(values.reshape(-1)))]), pa.array([ones], pa.list_(pa.int64()))], ["part", "file", "ones"])
    return run


def fit(texts: DataFrame, parts: int | None = None) -> Model:
    """Model of the texts (text). Three passes of counting; what they gather grows with the distinct words and bigrams."""
    spark = texts.sparkSession
    root, parts = shared_path(spark, "lm-arrays"), parts or max(8, shuffle_slices(spark))
    texts = texts.select("text")
    vocabulary, heavy = fit_vocabulary(texts, root, parts)
    if not vocabulary.total:
        return Model(vocabulary, np.zeros(0, np.int64), [], [], [], [], np.zeros(4), 0, discounts(np.zeros(4)), discounts(np.zeros(4)), 1.0)
    bounds = key_bounds(vocabulary, heavy, parts)
    blocks = texts.mapInArrow(_count_bigrams(vocabulary, bounds), BLOCKS)
    rows = materialise(_dealt(blocks, len(bounds)).mapInArrow(_write_bigrams(vocabulary, root), f"kind int, {BLOCKS}, files array<string>"), "lm-bigrams")
    ranges = sorted(((int(np.frombuffer(r.keys, np.int64)[0]), np.frombuffer(r.counts, np.int64), r.files) for r in rows.where("kind = 0").collect()), key=lambda r: r[0])
    totals = sum(r[1] for r in ranges)
    dense = {}
    for kind, columns, name in ((1, 4, "contexts"), (2, 1, "preceders")):
        own = rows.where(F.col("kind") == kind).select("part", "keys", "counts")
        found = sorted(_dealt(own, parts).mapInArrow(_write_dense(vocabulary, root, columns, name), "part int, file string, ones array<long>").collect())
        absent = set(range(len(vocabulary.hashes))) - {r.part for r in found}
        assert not absent, f"{name}: no rows for shards {absent}"
        dense[name] = [r.file for r in found], np.sum([r.ones for r in found], axis=0)
    types = int(totals[4])
    ones = dense["preceders"][1]
    word_discounts = discounts(ones[:4].astype(float))
    spare = float(word_discounts[1:] @ np.array([ones[0], ones[1], ones[4]])) / types
    return Model(vocabulary, np.array([r[0] for r in ranges], dtype=np.int64), [r[2][0] for r in ranges], [r[2][1] for r in ranges], dense["contexts"][0], dense["preceders"][0],
                 totals[5:9].astype(float), types, discounts(totals[:4].astype(float)), word_discounts, spare)


# Scores ----------------------------------------------------------------------------------------------------------

def _discount(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return table[np.minimum(counts, 3).astype(np.int64)]


def word_probabilities(model: Model, numbers: np.ndarray) -> np.ndarray:
    """Probability of sorted distinct words by the number of distinct words before them; -1 is an unknown word."""
    even = model.spare / (model.vocabulary.size + 1)
    out = np.full(len(numbers), even)
    known = numbers >= 0
    before = model.vocabulary.dense(model.preceders, numbers[known]).astype(np.float64)
    if len(before):
        out[known] += np.maximum(before - _discount(model.word_discounts, before), 0) / model.types
    return out


def context_values(model: Model, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, share left to single words) of sorted distinct contexts; unknown ones leave all."""
    told = np.zeros((len(numbers), 4))
    known = (numbers >= 0) & (numbers < model.vocabulary.size)
    if known.any():
        base = model.vocabulary.base
        edges = np.searchsorted(numbers[known], base)
        told[known] = np.concatenate([np.asarray(open_array(model.vocabulary.root, a)).reshape(-1, 4)[numbers[known][low:high] - b] for a, b, low, high in zip(model.contexts, base, edges[:-1], edges[1:]) if low < high])
    told[numbers == model.vocabulary.size] = model.begin
    occurrences = told[:, 3]
    left = told[:, :3] @ model.bigram_discounts[1:]
    return occurrences, np.where(occurrences > 0, left / np.maximum(occurrences, 1), 1.0)


def bigram_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct keys; 0 where a bigram is not known."""
    out = np.zeros(len(keys), dtype=np.int64)
    edges = np.append(np.searchsorted(keys, model.bounds), len(keys))
    for i, (a, c) in enumerate(zip(model.keys, model.counts)):
        low, high = edges[i], edges[i + 1]
        if low < high:
            known = open_array(model.vocabulary.root, a)
            place = np.searchsorted(known, keys[low:high])
            place[place == len(known)] = 0
            out[low:high] = np.where(known[place] == keys[low:high], open_array(model.vocabulary.root, c)[place], 0)
    return out


def score_texts(model: Model, column: pa.Array) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of each text, scores in log10."""
    v = model.vocabulary
    hashes, offsets = token_hashes(column)
    distinct, place = numbered(v, hashes)
    counts = np.zeros(len(distinct))
    counts[distinct >= 0] = v.dense(v.counts, distinct[distinct >= 0])
    base = np.log10((counts + 1) / (v.total + 1 * (v.size + 1)))
    single = word_probabilities(model, distinct)
    contexts = np.append(distinct, v.size)  # sorted: the begin mark has the largest number
    occurrences, left = context_values(model, contexts)
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[offsets[:-1]] = len(distinct)
    keys, back = np.unique((before << 32) | place, return_inverse=True)
    u, w = keys >> 32, keys & 0xFFFFFFFF
    met = np.zeros(len(keys), dtype=np.int64)
    both = (contexts[u] >= 0) & (distinct[w] >= 0)
    met[both] = bigram_counts(model, (contexts[u[both]] << 32) | distinct[w[both]])
    p = np.maximum(met - _discount(model.bigram_discounts, met), 0) / np.maximum(occurrences[u], 1) + left[u] * single[w]
    add = lambda values: np.add.reduceat(values, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
    return np.diff(offsets), add((counts > 0)[place].astype(np.int64)), add(base[place]), add(np.log10(p)[back])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of documents (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE):
                part = batch.slice(first, last - first)
                tokens, known, base, own = score_texts(shared.value, part.column("text"))
                trained = np.full(len(part), shared.value.vocabulary.total)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(trained, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(log10_probability: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -log10_probability / tokens)
