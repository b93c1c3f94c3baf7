"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for its first bytes; rows exist for
hashes met in enough training texts, all other hashes read as zero. Filters of several widths slide over whole
texts, each filter's largest response is kept, and a logistic layer turns these into a score. Score thresholds
are calibrated by language on all labelled texts the network has not seen.

The fit takes at most ``max_rows`` labelled texts a class (smallest hashes of the ids; longer texts than
``max_words`` are left out of the fit, never of scoring). Classes weigh as much as their counted shares of all
labels, in the fit and in the calibration. Texts, embeddings and filters are the score's only inputs.

Defined cases: null and empty texts pool to zeros and get the score of the bias; rows with a null label are not
learned from; without labels of both classes every score is the share of toxic labels (0 without labels); repeated
rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kerbflow.llm.common import WHITESPACE, hash_words, list_array, list_values, slices, split_words, word_class
from kerbflow.session import dealt

# Punctuation ends a word here, so that a word and the same word before a comma share a row.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_BYTES = word_class(WHITESPACE + PUNCTUATION)
TOKENS_AT_ONCE = 1 << 17


@dataclass
class Settings:
    max_rows: int = 2500
    max_words: int = 20000
    max_vocabulary: int = 200_000
    min_texts: int = 3
    prefix_bytes: int = 4
    dimension: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 64
    rate: float = 0.05
    shrink: float = 1e-5
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    words: np.ndarray  # sorted hashes; row i + 1 of the embedding, row 0 is zero
    prefixes: np.ndarray
    word_rows: np.ndarray
    prefix_rows: np.ndarray
    kernels: list[np.ndarray]  # by width: (width, dimension, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3


def features(column: pa.Array, prefix_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, prefix hashes and n + 1 word offsets of the texts."""
    data, starts, ends, offsets = split_words(column, WORD_BYTES)
    return hash_words(data, starts, ends), hash_words(data, starts, np.minimum(ends, starts + prefix_bytes)), offsets


def _rows(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 + place of each hash among the known ones, 0 for the others."""
    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    place = np.searchsorted(known, hashes)
    place[place == len(known)] = 0
    return np.where(known[place] == hashes, place + 1, 0)


def _responses(model: Model, x: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Filter responses at each word; ``left`` words follow in the same text, what lies beyond is zero."""
    out = []
    for kernel, bias in zip(model.kernels, model.biases):
        y = x @ kernel[0]
        for j in range(1, len(kernel)):
            if len(x) > j:
                y[:-j] += np.where((left[:-j] >= j)[:, None], x[j:] @ kernel[j], np.float32(0))
        out.append(np.maximum(y + bias, 0))
    return out


def pooled(model: Model, words: np.ndarray, prefixes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each text; zeros for texts without words. Works in slices of words."""
    texts, reach = len(offsets) - 1, max(model.settings.widths) - 1
    best = np.zeros((texts, len(model.weights)), dtype=np.float32)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for first in range(0, len(words), TOKENS_AT_ONCE):
        last = min(len(words), first + TOKENS_AT_ONCE)
        high = min(len(words), last + reach)
        x = model.word_rows[_rows(model.words, words[first:high])] + model.prefix_rows[_rows(model.prefixes, prefixes[first:high])]
        y = np.concatenate(_responses(model, x, ends[first:high] - np.arange(first, high) - 1), axis=1)[: last - first]
        low = int(np.searchsorted(offsets, first, side="right")) - 1
        top = int(np.searchsorted(offsets, last, side="left"))
        held = np.arange(low, top)[np.minimum(offsets[low + 1 : top + 1], last) > np.maximum(offsets[low:top], first)]
        best[held] = np.maximum(best[held], np.maximum.reduceat(y, np.maximum(offsets[held], first) - first, axis=0))
    return best


def scores(model: Model, words: np.ndarray, prefixes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = pooled(model, words, prefixes, offsets) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _common(values: list[np.ndarray], least: int, most: int) -> np.ndarray:
    """Sorted hashes met in at least ``least`` texts, the ``most`` frequent of them."""
    found, counts = np.unique(np.concatenate([np.unique(v) for v in values]), return_counts=True)
    found, counts = found[counts >= least], counts[counts >= least]
    if len(found) > most:
        found = np.sort(found[np.lexsort((found, -counts))[:most]])
    return found


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings, share: float | None = None) -> Model:
    """Fit the network on (word hashes, prefix hashes) of each text; adaptive gradient steps over mini-batches.

    Each class weighs as much as if ``share`` of all texts were toxic; by default, as in the texts given.
    """
    rng = np.random.default_rng(settings.seed)
    d, f = settings.dimension, settings.filters
    words = _common([t[0] for t in texts], settings.min_texts, settings.max_vocabulary) if texts else np.zeros(0, np.uint64)
    prefixes = _common([t[1] for t in texts], settings.min_texts, settings.max_vocabulary) if texts else np.zeros(0, np.uint64)
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    tables = [draw(len(words) + 1, d, scale=0.1), draw(len(prefixes) + 1, d, scale=0.1)]
    tables[0][0] = tables[1][0] = 0
    kernels = [draw(w, d, f, scale=0.5 / np.sqrt(w * d)) for w in settings.widths]
    biases = [np.zeros(f, np.float32) for _ in settings.widths]
    model = Model(settings, words, prefixes, *tables, kernels, biases, draw(f * len(settings.widths), scale=0.3), 0.0)
    own = float(labels.mean()) if len(labels) else 0.0
    if own in (0.0, 1.0):
        model.weights[:] = 0
        model.bias = 40.0 if own else -40.0
        return model
    share = own if share is None else share
    weight = np.where(labels > 0, share / own, (1 - share) / (1 - own)).astype(np.float32)
    model.bias = float(np.log(share / (1 - share)))
    ids = [(_rows(words, w), _rows(prefixes, p)) for w, p in texts]
    sums = {"E0": np.zeros_like(tables[0]), "E1": np.zeros_like(tables[1]), "w": np.zeros_like(model.weights), "b": 0.0}
    for i, k in enumerate(kernels):
        sums[f"K{i}"], sums[f"B{i}"] = np.zeros_like(k), np.zeros(f, np.float32)

    def step(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        sums[name] += gradient**2
        value -= settings.rate * gradient / (np.sqrt(sums[name]) + 1e-6)

    filled = np.array([i for i, (w, _) in enumerate(ids) if len(w)])
    for _ in range(settings.epochs):
        rng.shuffle(filled)
        for first in range(0, len(filled), settings.batch):
            chosen = filled[first : first + settings.batch]
            sizes = np.array([len(ids[i][0]) for i in chosen])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            rows = [np.concatenate([ids[i][side] for i in chosen]) for side in (0, 1)]
            x = tables[0][rows[0]] + tables[1][rows[1]]
            left = np.repeat(offsets[1:], sizes) - np.arange(offsets[-1]) - 1
            ys = _responses(model, x, left)
            places = [np.stack([y[a:b].argmax(axis=0) + a for a, b in zip(offsets[:-1], offsets[1:])]) for y in ys]
            tops = [np.take_along_axis(y, p, axis=0) for y, p in zip(ys, places)]
            h = np.concatenate(tops, axis=1)
            error = (1 / (1 + np.exp(-(h @ model.weights + model.bias))) - labels[chosen]).astype(np.float32) * weight[chosen] / len(chosen)
            back = error[:, None] * model.weights
            step("w", model.weights, h.T @ error + settings.shrink * model.weights)
            sums["b"] += float(error.sum()) ** 2
            model.bias -= settings.rate * float(error.sum()) / (np.sqrt(sums["b"]) + 1e-6)
            touched, pushed = [], []
            for i, kernel in enumerate(kernels):
                g = np.where(tops[i] > 0, back[:, i * f : (i + 1) * f], 0)
                slope = np.zeros_like(kernel)
                for j in range(len(kernel)):
                    inside = left[places[i]] >= j
                    at = np.minimum(places[i] + j, len(x) - 1)
                    gj = np.where(inside, g, 0)
                    slope[j] = np.einsum("bfd,bf->df", x[at], gj)
                    touched.append(at[gj != 0])
                    pushed.append((gj[:, :, None] * kernel[j].T[None])[gj != 0])
                step(f"B{i}", biases[i], g.sum(axis=0))
                step(f"K{i}", kernel, slope + settings.shrink * kernel)
            at, gradient = np.concatenate(touched), np.concatenate(pushed)
            for side, name in ((0, "E0"), (1, "E1")):
                own, inverse = np.unique(rows[side][at], return_inverse=True)
                total = np.zeros((len(own), d), np.float32)
                np.add.at(total, inverse, gradient)
                total, own = total[own > 0], own[own > 0]
                sums[name][own] += total**2
                tables[side][own] -= settings.rate * (total / (np.sqrt(sums[name][own]) + 1e-6) + settings.shrink * tables[side][own])
    return model


def calibrate(given: np.ndarray, toxic: np.ndarray, languages: list[str], rows: np.ndarray, weights: np.ndarray, least: int = 40) -> tuple[dict[str, float], float]:
    """Threshold of the best F1 by language (middle of the gap below), and over all languages together.

    An entry stands for ``rows`` labelled texts of one score, label and language, and weighs ``weights``.
    """

    def best(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> float | None:
        if not y.any() or y.all():
            return None
        order = np.argsort(-s, kind="stable")
        s, w, hits = s[order], np.cumsum(w[order]), np.cumsum(np.where(y, w, 0)[order])
        cut = np.flatnonzero(np.append(s[:-1] > s[1:], True))
        last = cut[np.argmax(2 * hits[cut] / (w[cut] + hits[-1]))]
        below = s[last + 1] if last + 1 < len(s) else 0.0
        return float((s[last] + below) / 2)

    overall = best(given, toxic, weights)
    names = np.array([x or "" for x in languages])
    found = {str(n): best(given[names == n], toxic[names == n], weights[names == n]) for n in np.unique(names) if rows[names == n].sum() >= least}
    return {n: t for n, t in found.items() if t is not None}, 0.3 if overall is None else overall


def _features(prefix_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                words, prefixes, offsets = features(part.column("text"), prefix_bytes)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold"), part.column("text_key"),
                                                  list_array(words.view(np.int64), offsets, pa.int64()), list_array(prefixes.view(np.int64), offsets, pa.int64())],
                                                 ["toxic", "fold", "text_key", "words", "prefixes"])
    return run


def fit(documents: DataFrame, labels: DataFrame, settings: Settings | None = None, learn_from: Column | None = None) -> Model:
    """Model from documents (doc_id, text, lang) and labels (doc_id, toxic); all labelled texts outside the fit calibrate."""
    settings = settings or Settings()
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows if learn_from is None else rows.where(learn_from)
    ordered = rows.withColumn("fold", F.xxhash64("doc_id"))
    n_toxic, n_all = (int(x or 0) for x in rows.agg(F.sum((F.col("toxic") > 0).cast("int")), F.count(F.lit(1))).first())
    sample = None
    for kind in (F.col("toxic") > 0, F.col("toxic") <= 0):
        side = ordered.where(kind).orderBy("fold", "doc_id").limit(settings.max_rows)
        sample = side if sample is None else sample.unionByName(side)
    # The sample has at most twice max_rows rows of three numbers.
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    # A fifth of the ids never enters the fit.
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", F.pmod("fold", F.lit(5)).cast("int").alias("fold"), key).where("fold > 0")
    found = texts.mapInArrow(_features(settings.prefix_bytes), "toxic int, fold int, text_key long, words array<long>, prefixes array<long>")
    table = found.where(F.size("words") <= settings.max_words).toArrow()
    seen: set[bytes] = set()
    kept = []
    for batch in table.to_batches():
        words, offsets = list_values(batch.column("words"))
        prefixes, _ = list_values(batch.column("prefixes"))
        for i, toxic in enumerate(batch.column("toxic").to_pylist()):
            own = words[offsets[i] : offsets[i + 1]]
            text = own.tobytes()
            if text not in seen:  # copies of one text would only add weight to its chance words
                seen.add(text)
                kept.append((text, int(toxic > 0), (own.view(np.uint64), prefixes[offsets[i] : offsets[i + 1]].view(np.uint64))))
    kept.sort(key=lambda r: r[0])
    model = train([r[2] for r in kept], np.array([r[1] for r in kept], dtype=np.float32), settings, n_toxic / n_all if n_all else None)
    if not kept:
        return model
    fitted = documents.sparkSession.createDataFrame([(k,) for k in set(table.column("text_key").to_pylist())], "text_key long")
    # Texts are scored before the join, so that none is shuffled.
    others = documents.select("doc_id", "text", "lang", key).join(F.broadcast(fitted), "text_key", "left_anti")
    others = score(others, model, ["doc_id", "lang"]).join(dealt(rows), "doc_id")
    # Scores are counted by their log odds at two decimals.
    odds = F.round(100 * F.log(F.col("score") / (1 - F.col("score")))).cast("int").alias("odds")
    counts = others.groupBy("lang", (F.col("toxic") > 0).alias("toxic"), odds).agg(F.count(F.lit(1)).alias("n")).collect()
    if counts:
        toxic, n = np.array([r.toxic for r in counts], dtype=bool), np.array([r.n for r in counts], dtype=np.float64)
        odds = np.array([np.inf if r.odds is None else r.odds for r in counts], dtype=np.float64)
        given = 1 / (1 + np.exp(-odds / 100))
        weights = n * np.where(toxic, n_toxic / max(n[toxic].sum(), 1), (n_all - n_toxic) / max(n[~toxic].sum(), 1))
        model.thresholds, model.threshold = calibrate(given, toxic, [r.lang for r in counts], n, weights)
    return model


def score(documents: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` of the documents (all by default) and the score under ``name``, which replaces a column of that name.

    Every whole text is scored; what is not kept doesn't leave the workers again.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c != name]
    chosen = documents.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([*(chosen.schema[c] for c in keep), StructField(name, DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                given = scores(shared.value, *features(part.column("text"), shared.value.settings.prefix_bytes))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(given)], [*keep, name])

    return chosen.mapInArrow(run, schema)


def rejected(model: Model, score_column: str = "score", language: str = "lang") -> Column:
    """Whether a score reaches the threshold of its language."""
    threshold = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        threshold = F.when(F.coalesce(F.col(language), F.lit("")) == name, F.lit(value)).otherwise(threshold)
    return F.col(score_column) >= threshold
