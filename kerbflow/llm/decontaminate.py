"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a row is a shard of consecutive documents with the sorted list of positions
of every term in them, so phrases are matched inside a shard and nothing but matches leaves it. A position is
counted over the shard with one free place after each document, which no phrase can cross. Test texts are taken
in blocks of a bounded number of words. Each test window starts from the postings of its rarest term over the whole
index; they are moved by the term's offset in the item and intersected with the lists of the terms around it.

Defined cases: null and empty texts have no words, are never hit, and items without words match nothing; an item
shorter than a window is one window; repeated rows give a result each; a null item id is hit but not named; an
empty table gives no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm.common import ALPHANUMERIC, hash_words, list_array, slices, split_words
from kerbflow.session import materialise

WINDOW = 13
SHARD_BYTES = 1 << 22
BLOCK_WORDS = 1 << 20
INDEX = "shard struct<task:int,row:int>, doc_ids array<long>, words array<int>, terms array<long>, sizes array<int>, positions array<int>"


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts, ends, offsets = split_words(batch.column("text"), ALPHANUMERIC)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), list_array(hash_words(data, starts, ends).view(np.int64), offsets, pa.int64())], ["item_id", "terms"])


class Items:
    """A block of test items: term numbers of all their words, and which item they belong to."""

    def __init__(self, ids: list[int | None], terms: list[np.ndarray]):
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, np.int64)]).view(np.uint64))
        self.words = np.searchsorted(self.vocabulary, np.concatenate([*terms, np.zeros(0, np.int64)]).view(np.uint64)).astype(np.int32)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.counts = np.zeros(len(self.vocabulary), dtype=np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of all windows."""
        lengths = np.diff(self.offsets)
        number = np.where(lengths > size, lengths - size + 1, np.minimum(lengths, 1))
        first = np.repeat(self.offsets[:-1], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        return first, np.repeat(np.minimum(lengths, size), number)

    def rarest(self, size: int) -> np.ndarray:
        """Places of the rarest word of each window that can occur; each place once."""
        starts, lengths = self.windows(size)
        reach = np.arange(size)
        places = starts[:, None] + np.minimum(reach, lengths[:, None] - 1) if len(starts) else np.zeros((0, size), np.int64)
        counts = self.counts[self.words[places]]
        best = counts.argmin(axis=1) if len(starts) else np.zeros(0, np.int64)
        rows = np.arange(len(starts))
        return np.unique(places[rows, best][counts[rows, best] > 0])


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Test items in blocks of about ``BLOCK_WORDS`` words, dealt by hash; only one block is held at a time."""
    items = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_tokenise, "item_id long, terms array<long>").where(F.size("terms") > 0), "decon-items")
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for block in range(blocks if total else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).toArrow()
        yield Items(rows.column("item_id").to_pylist(), [np.array(t, dtype=np.int64) for t in rows.column("terms").to_pylist()])


def build_index(documents: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Positional index of (doc_id, text); only terms of ``vocabulary`` (sorted hashes) if given. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row, wanted = TaskContext.get().partitionId(), 0, shared.value
        for batch in batches:
            for first, last in slices(batch.column("text"), SHARD_BYTES):
                part = batch.slice(first, last - first)
                data, starts, ends, offsets = split_words(part.column("text"), ALPHANUMERIC)
                hashes = hash_words(data, starts, ends)
                words = np.diff(offsets)
                positions = np.arange(len(hashes)) + np.repeat(np.arange(len(words)), words)
                if wanted is None:
                    terms, number = np.unique(hashes, return_inverse=True)
                elif not len(wanted):
                    terms, number, positions = wanted, np.zeros(0, np.int64), positions[:0]
                else:
                    terms = wanted
                    number = np.searchsorted(terms, hashes)
                    number[number == len(terms)] = 0
                    known = terms[number] == hashes
                    number, positions = number[known], positions[known]
                order = np.argsort(number.astype(np.uint16) if len(terms) < 1 << 16 else number, kind="stable")
                sizes = np.bincount(number, minlength=len(terms))
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays([
                    pa.StructArray.from_arrays([pa.array([task], pa.int32()), pa.array([row], pa.int32())], ["task", "row"]),
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("doc_id")), one(words, pa.int32()),
                    one(terms[sizes > 0].view(np.int64), pa.int64()), one(sizes[sizes > 0], pa.int32()), one(positions[order], pa.int32())],
                    ["shard", "doc_ids", "words", "terms", "sizes", "positions"])
                row += 1

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def term_counts(index: DataFrame, tests: Items) -> None:
    """Set the index-wide number of postings of each test term (the result is no larger than the block)."""
    known = index.sparkSession.createDataFrame(pa.table({"term": tests.vocabulary.view(np.int64)}))
    counted = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("n"))
    rows = counted.join(known, "term").toArrow()
    tests.counts[:] = 0
    tests.counts[np.searchsorted(tests.vocabulary, rows.column("term").to_numpy().view(np.uint64))] = rows.column("n").to_numpy()


def _shards(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("shard").slice(i, 1), *(np.asarray(batch.column(n)[i].values) for n in ("words", "terms", "sizes", "positions")), batch.column("doc_ids")[i].values


def _lists(tests: Items, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each test term's list in a shard."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    begin, number = np.zeros(len(tests.vocabulary), np.int64), np.zeros(len(tests.vocabulary), np.int64)
    place = np.searchsorted(tests.vocabulary, terms.view(np.uint64))
    place[place == len(tests.vocabulary)] = 0
    same = tests.vocabulary[place] == terms.view(np.uint64) if len(tests.vocabulary) else np.zeros(len(terms), bool)
    begin[place[same]], number[place[same]] = starts[same], sizes[same]
    return begin, number


def phrase_hits(tests: Items, anchors: np.ndarray, size: int, words: np.ndarray, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first word, end) of matched runs around the anchors in one shard."""
    begin, number = _lists(tests, terms, sizes)
    term = tests.words[anchors]
    count = number[term]
    place = np.repeat(begin[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    q, p = positions[place].astype(np.int64), np.repeat(anchors, count)
    starts = np.concatenate([[0], np.cumsum(words.astype(np.int64) + 1)])
    # Which test term has a posting at a place; asking it is the intersection with that term's moved list.
    posted = np.full(starts[-1] + 2 * size, -1, dtype=np.int32)
    total = number.sum()
    listed = np.flatnonzero(number)
    spread = np.repeat(listed, number[listed])
    source = np.repeat(begin[listed], number[listed]) + np.arange(total) - np.repeat(np.cumsum(number[listed]) - number[listed], number[listed])
    posted[positions[source].astype(np.int64) + size] = spread
    own = np.searchsorted(tests.offsets, p, side="right") - 1
    low, high = tests.offsets[own], tests.offsets[own + 1]
    need = np.minimum(high - low, size)

    def agrees(d: int, q: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inside = (p + d >= low) & (p + d < high)
        return inside & (posted[q + d + size] == tests.words[np.where(inside, p + d, p)])

    possible = (need == 1) | agrees(1, q, p, low, high) | agrees(-1, q, p, low, high)
    q, p, own, low, high, need = (x[possible] for x in (q, p, own, low, high, need))
    reach = []
    for side in (-1, 1):
        run, going = np.zeros(len(q), np.int64), np.arange(len(q))
        for d in range(1, size):
            going = going[agrees(side * d, q[going], p[going], low[going], high[going])]
            run[going] = d
        reach.append(run)
    full = reach[0] + reach[1] + 1 >= need
    q, own, left, right = q[full], own[full], reach[0][full], reach[1][full]
    document = np.searchsorted(starts, q, side="right") - 1
    first = q - left - starts[document]
    rows = np.unique(np.stack([document, own, first, first + left + right + 1]), axis=1)
    return rows[0], rows[1], rows[2], rows[3]


MATCHES = "shard struct<task:int,row:int>, ordinal int, doc_id long, item_id long, first int, end int"


def phrase_matches(index: DataFrame, tests: Items, size: int = WINDOW) -> DataFrame:
    """Runs of words that exactly match a window of a test item (or all of a shorter item)."""
    shared = index.sparkSession.sparkContext.broadcast((tests, tests.rarest(size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, anchors = shared.value
        for shard, words, terms, sizes, positions, doc_ids in _shards(batches):
            document, item, first, end = phrase_hits(known, anchors, size, words, terms, sizes, positions)
            if len(document):
                yield pa.RecordBatch.from_arrays([shard.take(pa.array(np.zeros(len(document), np.int32))), pa.array(document, pa.int32()), doc_ids.take(pa.array(document)),
                                                  pa.array([known.ids[i] for i in item], pa.int64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                                                 ["shard", "ordinal", "doc_id", "item_id", "first", "end"])

    return index.mapInArrow(run, MATCHES)


def proximity_matches(index: DataFrame, tests: Items, size: int = WINDOW, terms: int = 3, reach: int = 20) -> DataFrame:
    """Occurrences of a window's rarest term with its other ``terms`` - 1 rarest distinct terms at most ``reach`` words away.

    Windows follow each other without overlap. ``first`` is the word of the rarest term, ``end`` the largest distance.
    """
    groups = []
    for i, (low, high) in enumerate(zip(tests.offsets[:-1], tests.offsets[1:])):
        for start in range(int(low), int(high), size):
            own = np.unique(tests.words[start : min(start + size, int(high))])
            own = own[np.lexsort((own, tests.counts[own]))][:terms]
            if len(own) == terms and (tests.counts[own] > 0).all():
                groups.append((i, own))
    shared = index.sparkSession.sparkContext.broadcast((tests, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        for shard, words, listed, sizes, positions, doc_ids in _shards(batches):
            begin, number = _lists(known, listed, sizes)
            starts = np.concatenate([[0], np.cumsum(words.astype(np.int64) + 1)])
            for item, own in wanted:
                lists = [positions[begin[t] : begin[t] + number[t]].astype(np.int64) for t in own]
                if not all(len(x) for x in lists):
                    continue
                q = lists[0]
                document = np.searchsorted(starts, q, side="right") - 1
                far = np.zeros(len(q), np.int64)
                for other in lists[1:]:
                    nearest = np.full(len(q), np.iinfo(np.int64).max)
                    right = np.searchsorted(other, q)
                    for at in (right - 1, right):
                        valid = (at >= 0) & (at < len(other))
                        place = other[np.clip(at, 0, len(other) - 1)]
                        valid &= (place >= starts[document]) & (place < starts[document + 1])
                        nearest = np.where(valid, np.minimum(nearest, np.abs(place - q)), nearest)
                    far = np.maximum(far, nearest)
                hit = np.flatnonzero(far <= reach)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([shard.take(pa.array(np.zeros(len(hit), np.int32))), pa.array(document[hit], pa.int32()), doc_ids.take(pa.array(document[hit])),
                                                      pa.array([known.ids[item]] * len(hit), pa.int64()), pa.array(q[hit] - starts[document[hit]], pa.int32()), pa.array(far[hit], pa.int32())],
                                                     ["shard", "ordinal", "doc_id", "item_id", "first", "end"])

    return index.mapInArrow(run, MATCHES)


def contaminated(hit: Column, words: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (hit > 0) & (20 * hit >= words)


def summarise(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document (shard, ordinal, doc_id): words, hit words, items with occurring windows, and the verdict."""
    pair = F.posexplode(F.arrays_zip("doc_ids", "words")).alias("ordinal", "d")
    documents = index.select("shard", pair).select("shard", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.words").cast("long").alias("n_words"))
    before = Window.partitionBy("shard", "ordinal").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = matches.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("first", "covered"))
    hits = covered.groupBy("shard", "ordinal").agg(F.sum(fresh).alias("hit"), F.collect_set("item_id").alias("items"))
    joined = documents.join(hits, ["shard", "ordinal"], "left")
    hit, items = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<long>"))
    return joined.select("shard", "ordinal", "doc_id", "n_words", hit.alias("n_hit"), F.sort_array(F.transform(items, lambda x: x.cast("string"))).alias("items"),
                         contaminated(hit, F.col("n_words")).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Verdicts of ``summarise`` for documents (doc_id, text) against a benchmark (item_id, text)."""
    index = matches = None
    for tests in item_blocks(benchmark):
        own = materialise(build_index(documents, tests.vocabulary), "decon-index")
        term_counts(own, tests)
        found = phrase_matches(own, tests, size)
        index, matches = own, found if matches is None else matches.unionByName(found)
    if index is None:
        index = materialise(build_index(documents, np.zeros(0, np.uint64)), "decon-index")
        matches = documents.sparkSession.createDataFrame([], MATCHES)
    return summarise(index, matches)
