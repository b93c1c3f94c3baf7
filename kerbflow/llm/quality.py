"""Quality rules with an isolation forest over rule statistics.

Every whole text gives counts (words, code points, symbols, repeated lines, words in repeated windows, ...); two fixed
rules fail texts outright. The statistics of the other texts are points of an isolation forest: trees of random
splits, where an odd point is parted from the rest after few splits. Scores of labelled texts give the threshold.

The forest grows on ``trees * sample`` texts (the smallest seeded hashes of the rows' keys, a bounded sample by the
method's own definition). Which statistics it splits on is found on at most ``max_labelled`` labelled texts a class:
starting from none, the statistic that tells good from bad best is added as long as that helps (all of them without
labels of both classes). Every text is scored. The threshold comes from all labelled texts that pass the fixed rules,
counted by score bin in Spark: the bin edge with the best balance of bad texts caught and good ones lost, of which no
more than the share ``most_good_lost`` may go; without bad labels or without such an edge no text is rejected by it.

Defined cases: null and empty texts have no words and fail the word rule; rows without a label are scored and not
calibrated on; repeated rows are scored each; texts of any length are counted whole; an empty table gives no rows;
columns named as the statistics are replaced by them, other columns are kept only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import WHITESPACE, slices, text_buffer
from kerbflow.session import materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_capitals", "n_stops", "longest_word"]
SYMBOLS = b"#*$%&|<>"
BINS = 1000


@dataclass
class Settings:
    trees: int = 100
    sample: int = 256
    window: int = 8
    least_words: int = 20
    most_repeat_percent: int = 30
    most_good_lost: float = 0.01
    max_labelled: int = 4000
    least_gain: float = 0.005
    seed: int = 11


@dataclass
class Forest:
    """Trees as flat arrays; a leaf points to itself and carries its path length."""

    settings: Settings
    columns: list[int]  # of ``points``
    feature: np.ndarray  # (trees, nodes)
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    threshold: float = float("inf")


def _byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int8)
    table[list(members)] = 1
    return table


_SPACE = _byte_table(WHITESPACE)
_WEIGHTS = {
    "word_chars": ((np.arange(256) & 0xC0) != 0x80).astype(np.int8) - _SPACE,
    "n_symbols": _byte_table(SYMBOLS),
    "n_digits": _byte_table(b"0123456789"),
    "n_capitals": _byte_table(bytes(range(65, 91))),
    "n_stops": _byte_table(b".!?"),
}


def repeated_words(numbers: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Words of each text that stand in a window found twice or more in it; ``numbers`` name the words exactly."""
    total, texts = len(numbers), len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    if total < window:
        return np.zeros(texts, dtype=np.int64)
    # Names of windows of 1, 2, 4, ... words are joined in pairs until they span the whole window.
    names, span = numbers.astype(np.int64), 1
    while span < window:
        step = min(span, window - span)
        pair = names[: len(names) - step] * (names.max() + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1].ravel().astype(np.int64)
        span += step
    starts = np.flatnonzero(owner[: len(names)] == owner[window - 1 :])
    _, name, count = np.unique(owner[starts] * (names.max() + 1) + names[starts], return_inverse=True, return_counts=True)
    again = starts[count[name.ravel()] > 1]
    cover = np.zeros(total + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=texts)


def count_texts(column: pa.Array, window: int) -> dict[str, np.ndarray]:
    """The counts of every text, named as in ``COUNTS``."""
    data, offsets = text_buffer(column)
    out = {}
    filled = np.diff(offsets) > 0
    for name, weights in _WEIGHTS.items():
        out[name] = np.zeros(len(filled), dtype=np.int64)
        if filled.any():
            out[name][filled] = np.add.reduceat(weights[data], offsets[:-1][filled], dtype=np.int64)
    whole, known, numbers, lines = data.tobytes(), {}, [], []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = whole[start:end]
        words = text.split()  # bytes split at ASCII white space alone
        first = len(numbers)
        numbers.extend([known.setdefault(word, len(known)) for word in words])
        held = [line for line in text.split(b"\n") if line and not line.isspace()]
        lines.append((len(words), len(set(numbers[first:])), max(map(len, words), default=0), len(held), len(held) - len(set(held))))
    n_words, distinct, longest, n_lines, again = np.array(lines, dtype=np.int64).reshape(-1, 5).T
    starts = np.concatenate([[0], np.cumsum(n_words)])
    repeats = repeated_words(np.array(numbers, dtype=np.int64), starts, window)
    return out | {"n_words": n_words, "n_distinct_words": distinct, "longest_word": longest, "n_lines": n_lines, "n_dup_lines": again, "n_repeat_words": repeats}


def statistics(documents: DataFrame, keep: list[str], settings: Settings | None = None, text_column: str = "text") -> DataFrame:
    """``keep`` columns and the counts of every text."""
    window = (settings or Settings()).window
    kept = [c for c in keep if c not in COUNTS]
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            for first, last in slices(texts):
                part = batch.slice(first, last - first)
                found = count_texts(part.column("__text"), window)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(found[c], pa.int64()) for c in COUNTS)], kept + COUNTS)

    return documents.select(*kept, F.col(text_column).alias("__text")).mapInArrow(run, schema)


def failed(settings: Settings) -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < settings.least_words) | (100 * F.col("n_repeat_words") > settings.most_repeat_percent * F.col("n_words"))


def points(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares and logarithms of the counts, one row a text."""
    words, chars = np.maximum(counts["n_words"], 1).astype(np.float64), np.maximum(counts["word_chars"], 1).astype(np.float64)
    return np.stack([
        np.log1p(words), counts["word_chars"] / words, counts["n_symbols"] / chars, counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
        counts["n_repeat_words"] / words, counts["n_distinct_words"] / words ** 0.8, counts["n_digits"] / chars, counts["n_capitals"] / chars,
        counts["n_stops"] / words, np.log1p(counts["longest_word"])], axis=1)


def expected_length(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points: what a leaf of n points still stands for."""
    n = np.asarray(n, dtype=np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(sample: np.ndarray, settings: Settings, columns: list[int] | None = None) -> Forest:
    """Trees over consecutive slices of the sampled points, split at random between the extremes of a random column."""
    columns = list(range(sample.shape[1])) if columns is None else columns
    sample = sample[:, columns]
    rng = np.random.default_rng(settings.seed)
    sample = sample[rng.permutation(len(sample))]
    size = min(settings.sample, len(sample))
    limit = int(np.ceil(np.log2(max(size, 2))))
    trees = []
    for t in range(settings.trees):
        picked = sample[np.arange(t * size, (t + 1) * size) % len(sample)] if len(sample) else sample
        nodes, waiting = [[0, np.inf, 0, 0, 0.0]], [(0, picked, 0)]
        while waiting:
            node, here, depth = waiting.pop()
            spread = np.flatnonzero(here.max(axis=0) > here.min(axis=0)) if len(here) else []
            if depth == limit or not len(spread):
                nodes[node] = [0, np.inf, node, node, depth + float(expected_length(len(here)))]
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(here[:, f].min(), here[:, f].max()))
            below = here[:, f] <= cut
            nodes[node] = [f, cut, len(nodes), len(nodes) + 1, 0.0]
            nodes += [[0, np.inf, 0, 0, 0.0]] * 2
            waiting += [(nodes[node][2], here[below], depth + 1), (nodes[node][3], here[~below], depth + 1)]
        trees.append(nodes)
    most = max(map(len, trees))
    padded = np.array([nodes + [[0, np.inf, 0, 0, 0.0]] * (most - len(nodes)) for nodes in trees])
    return Forest(settings, columns, padded[:, :, 0].astype(int), padded[:, :, 1], padded[:, :, 2].astype(int), padded[:, :, 3].astype(int), padded[:, :, 4], limit)


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Score from 0 to 1, higher for points parted sooner, to nine places."""
    x, total = x[:, forest.columns], np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, left, right, length in zip(forest.feature, forest.split, forest.left, forest.right, forest.length):
        node = np.zeros(len(x), dtype=int)
        for _ in range(forest.depth):
            node = np.where(x[rows, feature[node]] <= split[node], left[node], right[node])
        total += length[node]
    usual = max(float(expected_length(forest.settings.sample)), 1e-9)
    return np.round(2.0 ** (-total / len(forest.length) / usual), 9)


def score(counted: DataFrame, forest: Forest) -> DataFrame:
    """The rows with ``anomaly`` added."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.drop("anomaly").schema.fields) + ", anomaly double"
    kept = [c for c in counted.columns if c != "anomaly"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anomaly(forest, points({c: np.asarray(batch.column(c)) for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, "anomaly"])

    return counted.select(*kept).mapInArrow(run, schema)


def best_edge(bins: list[tuple[int, int, int]], most_good_lost: float) -> tuple[float, float]:
    """Threshold from (bin, good texts, bad texts), and the share of bad texts above it less the share of good ones."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, g, w in bins:
        good[b], bad[b] = g, w
    if not bad.sum() or not good.sum():
        return float("inf"), 0.0
    lost, caught = (np.cumsum(side[::-1])[::-1] / side.sum() for side in (good, bad))
    gain = np.where(lost <= most_good_lost, caught - lost, -1.0)
    edge = int(np.argmax(gain))
    return (edge / BINS, float(gain[edge])) if gain[edge] > 0 else (float("inf"), 0.0)


def _gain(sample: np.ndarray, good: np.ndarray, bad: np.ndarray, columns: list[int], settings: Settings) -> float:
    forest = grow(sample, settings, columns)
    counts = [np.bincount((anomaly(forest, side) * BINS).astype(int), minlength=BINS + 1) for side in (good, bad)]
    return best_edge(list(zip(range(BINS + 1), *counts)), settings.most_good_lost)[1]


def chosen_columns(sample: np.ndarray, good: np.ndarray, bad: np.ndarray, settings: Settings) -> list[int]:
    """Statistics added one by one, each the one that helps most to tell good points from bad ones."""
    chosen, reached = [], 0.0
    while len(good) and len(bad) and len(chosen) < sample.shape[1]:
        gains = {c: _gain(sample, good, bad, [*chosen, c], settings) for c in range(sample.shape[1]) if c not in chosen}
        column = max(gains, key=gains.get)
        if gains[column] < reached + settings.least_gain:
            break
        chosen, reached = [*chosen, column], gains[column]
    return chosen or list(range(sample.shape[1]))


def _points_of(rows: DataFrame) -> np.ndarray:
    table = rows.select(*COUNTS).toArrow()
    return points({c: np.asarray(table.column(c)) for c in COUNTS})


def fit(counted: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", settings: Settings | None = None) -> Forest:
    """Forest over a sample of the counted texts, and its threshold from all labelled ones (1 good, 0 bad)."""
    settings = settings or Settings()
    passing = counted.where(~failed(settings))
    # Samples are picked by hash, so they are the same wherever the rows lie.
    order = [F.xxhash64(F.lit(settings.seed), F.col(key).cast("string")), *COUNTS]
    sample = _points_of(passing.orderBy(*order).limit(settings.trees * settings.sample))
    marked = labels.where(F.col(good).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.min(good).alias("__good"))
    known = materialise(passing.join(marked, F.col(key) == F.col("__key")).select(key, "__good", *COUNTS), "quality-labelled")
    sides = [_points_of(known.where(F.col("__good") == side).orderBy(*order).limit(settings.max_labelled)) for side in (1, 0)]
    forest = grow(sample, settings, chosen_columns(sample, *sides, settings))
    bins = score(known, forest).groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
    found = bins.agg(F.sum("__good").alias("good"), F.count(F.lit(1)).alias("rows")).collect()  # BINS + 1 rows at most
    forest.threshold, _ = best_edge([(r.bin, r.good, r.rows - r.good) for r in found], settings.most_good_lost)
    return forest


def judge(documents: DataFrame, labels: DataFrame, key: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """Key, counts, ``base_failed``, ``anomaly`` and ``kept`` of every document."""
    settings = settings or Settings()
    counted = materialise(statistics(documents, [key], settings), "quality-counts")
    forest = fit(counted, labels, key, settings=settings)
    judged = score(counted, forest).withColumn("base_failed", failed(settings))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < forest.threshold))
