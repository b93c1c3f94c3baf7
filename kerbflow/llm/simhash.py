"""SimHash near-duplicate detection with bit-sliced comparison.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's word shingles. Fingerprints within
a radius share a key: with radius 4 or less, two of six blocks of bits agree; up to radius 11, one of four blocks
differs in two bits at most, so the two meet under that block's value with one bit flipped on either side. Distinct
fingerprints under one key are compared in a bit-sliced way: 64 fingerprints stand in one word of each of 64 bit
planes, a query adds its differing bits to carry-save counters, one plane after the other, and words in which every
lane exceeds the radius are abandoned. Keys with many fingerprints are cut into chunks and dealt as pairs of chunks.
No copies are expanded: linked fingerprints of a key are reported as a spanning forest.

Defined cases: null and empty texts have no shingles and fingerprint zero, linked like any other; texts with fewer
words than a shingle are one shingle; a null id is no component id unless all ids of a component are null; repeated
rows are kept, one result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import mix, slices, text_buffer
from kerbflow.llm.graph import components
from kerbflow.session import materialise

SEED = 42
CHUNK = 1024
TASKS_AT_ONCE = 1 << 15
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, in order, and n + 1 offsets."""
    data, offsets = text_buffer(column)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(offsets), dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        found = raw[a:b].lower().split()
        if not found:
            continue
        joined = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(joined, SEED))
            counts[i + 1] = 1
            continue
        ends = list(itertools.accumulate(map((1).__add__, map(len, found))))
        starts = [0, *ends[: len(found) - words]]
        hashes += [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])]
        counts[i + 1] = len(starts)
    return np.fromiter(hashes, dtype=np.uint64, count=len(hashes)), np.cumsum(counts)


def distinct_in_texts(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Majority of each bit over each text's hashes; byte histograms give the counts of eight bits at once."""
    texts, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(texts, dtype=np.int64) << 8, sizes)
    parts = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    out = np.zeros((texts, 8), dtype=np.uint8)
    for k in range(8):
        ones = np.bincount(owner + parts[:, k], minlength=texts << 8).reshape(texts, 256) @ _BITS
        out[:, k] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.reshape(-1).view(np.uint64)


def set_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash of each text's distinct hashes, whatever their order."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(SEED)), out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), 1 << 22):
                part = batch.slice(first, last - first)
                found = fingerprints(*shingle_hashes(part.column("text"), words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])
    return run


def sketches(documents: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every document."""
    return documents.select("doc_id", "text").mapInArrow(_sketch(words), "doc_id long, fp long")


def keys(radius: int) -> Column:
    """Array of (block, value) under which fingerprints within the radius meet."""
    fp = F.col("fp")
    if radius <= 4:
        edges = [round(64 * i / 6) for i in range(7)]
        masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(6)]
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        pairs = [F.struct(F.lit(t).alias("block"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("value")) for t, (i, j) in enumerate(itertools.combinations(range(6), 2))]
        return F.array(*pairs)
    if radius > 11:
        raise ValueError("radius above 11")
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(16)])
    block = lambda b: F.transform(flips, lambda m: F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF).bitwiseXOR(m.cast("long")).alias("value")))
    return F.concat(*[block(b) for b in range(4)])


def bit_planes(words: np.ndarray) -> np.ndarray:
    """Planes (64, n) of words of 64 fingerprints (n, 64): bit i of plane b of a word is bit b of its fingerprint i."""
    planes = np.empty((64, len(words)), dtype=np.uint64)
    for b in range(64):
        lanes = ((words >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return planes


def near_lanes(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (query, word) task the lanes within the radius, as (tasks with any, their lane masks).

    A counter of four bits a lane (more for a radius above 15) is kept as so many words of bits; a lane whose count passes the radius is over for
    good, and a task is dropped as soon as all its lanes are over.
    """
    task = np.arange(len(word))
    over = np.zeros(len(word), dtype=np.uint64)
    places = range(max(4, radius.bit_length()))
    c = [np.zeros(len(word), dtype=np.uint64) for _ in places]
    zero, one = np.uint64(0), np.uint64(1)
    limit = [np.uint64(0xFFFFFFFFFFFFFFFF) if (radius >> i) & 1 else zero for i in places]
    for b in range(64):
        carry = planes[b][word] ^ (zero - ((query >> np.uint64(b)) & one))
        for i in places:
            c[i], carry = c[i] ^ carry, c[i] & carry
        over |= carry
        if b % 4 == 3 and b > radius:
            more, equal = np.zeros_like(over), ~np.zeros_like(over)
            for i in reversed(places):
                more |= equal & c[i] & ~limit[i]
                equal &= ~(c[i] ^ limit[i])
            over |= more
            alive = ~over != 0
            if not alive.all():
                task, word, query, over = task[alive], word[alive], query[alive], over[alive]
                c = [x[alive] for x in c]
    return task, ~over


def bucket_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b, of fingerprints of one group within the radius; groups are contiguous.

    Groups stand in the lanes one after the other; lanes of other groups in a word are left out of the result.
    """
    new = np.concatenate([[True], group[1:] != group[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    kept = np.flatnonzero(np.repeat(sizes > 1, sizes))
    empty = np.zeros(0, dtype=np.int64)
    size = len(kept)
    if not size:
        return empty, empty
    sizes = sizes[sizes > 1]
    own = np.repeat(np.arange(len(sizes)), sizes)
    last_word = (np.cumsum(sizes) - 1 >> 6)[own]
    lanes = np.zeros(-(-size // 64) * 64, dtype=np.uint64)
    lanes[:size] = fp[kept]
    planes = bit_planes(lanes.reshape(-1, 64))
    # Only words at or after a query's own are needed: the pair is met from its earlier side.
    at = np.arange(size)
    spans = last_word - (at >> 6) + 1
    ends = np.cumsum(spans)
    found_a, found_b, first = [empty], [empty], 0
    while first < size:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TASKS_AT_ONCE, side="right")))
        count = spans[first:last]
        query = np.repeat(at[first:last], count)
        word = (query >> 6) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        task, mask = near_lanes(planes, word, lanes[query], radius)
        row, lane = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = query[task[row]], word[task[row]] * 64 + lane
        good = (b > a) & (b < size)
        a, b = a[good], b[good]
        good = own[a] == own[b]
        found_a.append(kept[a[good]])
        found_b.append(kept[b[good]])
        first = last
    return np.concatenate(found_a), np.concatenate(found_b)


def spanning_labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place connected to each place."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(group numbers, nodes, fingerprints) of whole groups; the last group of a batch waits for the next batch."""
    names = ("block", "value", "low", "high", "node", "fp")
    kept = {n: np.zeros(0, dtype=np.int64) for n in names}
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            kept = {n: np.concatenate([kept[n], batch.column(n).to_numpy().astype(np.int64)]) for n in names}
        size = len(kept["fp"])
        if not size:
            continue
        new = np.zeros(size, dtype=bool)
        for n in names[:4]:
            new[1:] |= kept[n][1:] != kept[n][:-1]
        cut = size if batch is None else (int(np.flatnonzero(new)[-1]) if new.any() else 0)
        if cut:
            yield np.cumsum(new[:cut]), kept["node"][:cut], kept["fp"][:cut].view(np.uint64)
            kept = {n: v[cut:] for n, v in kept.items()}


def _compare(radius: int):
    """Links of each key as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, node, fp in _grouped(batches):
            a, b = bucket_links(group, fp, radius)
            label = spanning_labels(len(fp), a, b)
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], ["u", "v"])
    return run


def dealt(nodes: DataFrame, radius: int) -> DataFrame:
    """Nodes (node, fp, ...) under their keys (block, value, low, high), whole keys together and in order.

    Keys with more than ``CHUNK`` nodes are cut into chunks; a row goes to every pair of chunks that holds its own.
    """
    keyed = nodes.select("*", F.explode(keys(radius)).alias("key")).select(*nodes.columns, F.col("key.block").alias("block"), F.col("key.value").alias("value"))
    large = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    large = materialise(large.select("block", "value", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "simhash-large")
    if large.isEmpty():
        rows = keyed.withColumns({"low": F.lit(0), "high": F.lit(0)})
    else:
        rows = keyed.join(large, ["block", "value"], "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        rows = rows.select(*nodes.columns, "block", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    names = ["block", "value", "low", "high"]
    return rows.select(*names, *nodes.columns).repartition(*names).sortWithinPartitions(*names)


def linked(distinct: DataFrame, radius: int) -> DataFrame:
    """(node, label) of all distinct fingerprints linked to another one; a fingerprint is its own node."""
    nodes = distinct.select(F.col("fp").alias("node"), "fp")
    return components(dealt(nodes, radius).mapInArrow(_compare(radius), "u long, v long").distinct())


def near_duplicates(documents: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the smallest id reachable over links."""
    docs = materialise(sketches(documents, words), "simhash-docs")
    distinct = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = linked(distinct, radius).withColumnsRenamed({"node": "fp"})
    named = materialise(distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return docs.join(named.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
