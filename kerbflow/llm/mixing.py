"""Document rates that mix soft domains to target weights.

A linear classifier over hashed word features, fitted in numpy on a bounded sample of labelled rows, gives every
document a posterior over domains. Nonnegative rates then minimise the squared distance between the expected domain
totals (sum of rate x words x posterior) and the targets by projected gradient steps: a step is scaled by the small
matrix of domain overlaps, each document applies it to its own rate and cuts it at zero, and only sums by domain
leave the tasks. A document's rate follows from the list of steps, so no rate table is written between steps.

Defined cases: null and empty texts have no words, the prior as posterior, and move no total; rows without a label
are not learned from; a domain that no labelled row names cannot be learned, so it is left out and the weights of the others
are scaled up; without any labels all domains are equally likely; targets without any words to meet them stay unmet as
far as least squares goes; repeated rows get equal rates; an empty table gives no rows; other columns are
kept where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kerbflow.llm.common import SPACED, hash_words, list_array, list_values, segment_sums, slices, split_words
from kerbflow.session import materialise

MAX_ROWS = 1500  # labelled rows a domain
BUCKETS = 1 << 15
EDGE = 3  # bytes of a word's first and last part


@dataclass
class Model:
    domains: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, domains)
    bias: np.ndarray


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) buckets of each word, its first and its last bytes, and n + 1 word offsets."""
    data, starts, ends, offsets = split_words(column, SPACED)
    parts = [hash_words(data, starts, ends), hash_words(data, starts, np.minimum(ends, starts + EDGE)), ~hash_words(data, np.maximum(starts, ends - EDGE), ends)]
    return np.stack([(p >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1) for p in parts], axis=1), offsets


def posteriors(model: Model, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Softmax of the bias and the mean weight of each text's words."""
    sizes = np.diff(offsets)
    out = np.empty((len(sizes), len(model.domains)))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 18), side="right")) - 1)
        own = buckets[offsets[first] : offsets[last]]
        total = segment_sums(model.weights[own[:, 0]] + model.weights[own[:, 1]] + model.weights[own[:, 2]], offsets[first : last + 1] - offsets[first])
        z = model.bias + total / np.maximum(sizes[first:last], 1)[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[first:last] = z / z.sum(axis=1, keepdims=True)
        first = last
    return out


def train(texts: list[np.ndarray], labels: np.ndarray, domains: tuple[str, ...], epochs: int = 12, batch: int = 64, rate: float = 0.5, seed: int = 11) -> Model:
    """Softmax regression with adaptive steps over mini-batches."""
    k = len(domains)
    counts = np.bincount(labels, minlength=k) + 1.0 if len(labels) else np.ones(k)
    model = Model(domains, np.zeros((BUCKETS, k), np.float32), np.log(counts / counts.sum()))
    seen = np.full((BUCKETS, k), 1e-4, np.float32)
    rng = np.random.default_rng(seed)
    filled = np.array([i for i, t in enumerate(texts) if len(t)], dtype=int)
    for _ in range(epochs):
        rng.shuffle(filled)
        for first in range(0, len(filled), batch):
            chosen = filled[first : first + batch]
            sizes = np.array([len(texts[i]) for i in chosen])
            own = np.concatenate([texts[i] for i in chosen])
            slope = posteriors(model, own, np.concatenate([[0], np.cumsum(sizes)]))
            slope[np.arange(len(chosen)), labels[chosen]] -= 1
            each = np.repeat(slope / sizes[:, None] / len(chosen), sizes, axis=0)
            flat = own.reshape(-1)
            each = np.repeat(each, own.shape[1], axis=0)
            touched = np.unique(flat)
            g = np.stack([np.bincount(flat, each[:, j], minlength=BUCKETS)[touched] for j in range(k)], axis=1).astype(np.float32)
            seen[touched] += g**2
            model.weights[touched] -= rate * g / np.sqrt(seen[touched])
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in slices(batch.column("text")):
            part = batch.slice(first, last - first)
            buckets, offsets = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("domain"), list_array(buckets.reshape(-1), 3 * offsets, pa.int32())], ["domain", "buckets"])


def fit(documents: DataFrame, labels: DataFrame, domain: Column, domains: tuple[str, ...], max_rows: int = MAX_ROWS, max_words: int = 20000) -> Model:
    """Classifier from documents (doc_id, text) and a labelled table with doc_id; ``domain`` names a joined row's domain.

    At most ``max_rows`` labelled rows a domain are used (smallest hashes of the ids), texts of more than ``max_words``
    words are left out of the fit. The model knows the domains that a row of the fit names, all of them if there is none.
    """
    named = labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
    sample = None
    for name in domains:
        own = named.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        sample = own if sample is None else sample.unionByName(own)
    # At most max_rows rows a domain.
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "domain")
    table = chosen.mapInArrow(_sampled, "domain string, buckets array<int>").where(F.size("buckets") <= 3 * max_words).toArrow()
    rows = []
    for batch in table.to_batches():
        values, offsets = list_values(batch.column("buckets"))
        rows += [(values[a:b].reshape(-1, 3), name) for a, b, name in zip(offsets[:-1], offsets[1:], batch.column("domain").to_pylist())]
    rows.sort(key=lambda r: (r[1], r[0].tobytes()))
    held = {r[1] for r in rows}
    domains = tuple(d for d in domains if d in held) or domains
    return train([r[0] for r in rows], np.array([domains.index(r[1]) for r in rows], dtype=int), domains)


def classify(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``n_words`` and ``posterior``; every whole text is read. Own columns of these names go."""
    keep = [c for c in keep if c not in ("n_words", "posterior")]
    chosen = documents.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([*(chosen.schema[c] for c in keep), StructField("n_words", LongType()), StructField("posterior", ArrayType(DoubleType()))])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                buckets, offsets = features(part.column("text"))
                p = posteriors(shared.value, buckets, offsets)
                ends = np.arange(len(part) + 1) * p.shape[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(offsets), pa.int64()), list_array(p.reshape(-1), ends, pa.float64())], [*keep, "n_words", "posterior"])

    return chosen.mapInArrow(run, schema)


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps, from one; each step is cut at zero."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r + p @ step)
    return r


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    values, _ = list_values(batch.column("posterior"))
    return values.reshape(-1, k)


def _totals(k: int, steps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * k + k * k)
        for batch in batches:
            p, n = _matrix(batch, k), batch.column("n_words").to_numpy().astype(np.float64)
            r = rates_of(p, steps)
            open_ = n * (r > 0)
            sums += np.concatenate([(n * r) @ p, n @ p, ((p * open_[:, None]).T @ p).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["cell", "value"])
    return run


@dataclass
class Mix:
    steps: list[np.ndarray]
    totals: np.ndarray
    targets: np.ndarray
    rounds: int

    @property
    def residual(self) -> float:
        """Largest distance of a domain's share of the words to its target."""
        whole = self.targets.sum()
        return float(np.abs(self.totals - self.targets).max() / whole) if whole else 0.0


def solve(classified: DataFrame, weights: np.ndarray, tolerance: float = 1e-9, still: float = 1e-6) -> Mix:
    """Steps of the projected-gradient fit to ``weights`` (summing to one) of all words.

    Each round is one job whose result is 2k + k*k sums. The scaling matrix has a ridge that falls while steps come nearer
    and grows when one does not, which turns and shortens the step towards the plain gradient. The fit ends when the
    targets are met, or when targets that no rates meet are as near as they get: no step is nearer, or three in a row
    were nearer by less than the share ``still``. ``Mix.residual`` tells which.
    """
    k = len(weights)

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = classified.select("n_words", "posterior").mapInArrow(_totals(k, steps), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        sums = np.zeros(2 * k + k * k)
        for row in found.toArrow().to_pylist():
            sums[row["cell"]] = row["value"]
        return sums[:k], sums[k : 2 * k], sums[2 * k :].reshape(k, k)

    totals, words, overlap = measure([])
    whole = words.sum()
    mix = Mix([], totals, weights * whole, 0)
    if not whole:
        return mix
    distance = lambda t: float(((t - mix.targets) ** 2).sum()) / whole**2
    ridge, slow = 1e-6, 0
    while distance(mix.totals) > tolerance**2 and ridge < 1e9 and slow < 3:
        mix.rounds += 1
        step = np.linalg.solve(overlap + ridge * (np.trace(overlap) / k + 1e-12) * np.eye(k), mix.targets - mix.totals)
        trial = [*mix.steps, step]
        new, _, matrix = measure(trial)
        if distance(new) < distance(mix.totals):
            slow = slow + 1 if distance(new) > (1 - still) * distance(mix.totals) else 0
            mix.steps, mix.totals, overlap, ridge = trial, new, matrix, max(ridge / 4, 1e-9)
        else:
            ridge *= 8
    return mix


def with_rates(classified: DataFrame, mix: Mix, keep: list[str], k: int) -> DataFrame:
    """Columns ``keep`` and ``rate``."""
    keep = [c for c in keep if c != "rate"]
    chosen = classified.select(*dict.fromkeys([*keep, "posterior"]))
    schema = StructType([*(chosen.schema[c] for c in keep), StructField("rate", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rates_of(_matrix(batch, k), mix.steps))], [*keep, "rate"])

    return chosen.mapInArrow(run, schema)


def copies(rate: Column, *identity: Column | str) -> Column:
    """Whole number of copies whose expectation is the rate; the draw is a hash of the row's identity."""
    draw = F.pmod(F.xxhash64(*identity), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def mix_documents(documents: DataFrame, model: Model, weights: dict[str, float], keep: list[str]) -> tuple[DataFrame, Mix]:
    """Columns ``keep``, ``n_words``, ``posterior`` and ``rate`` for every document, and the fit."""
    target = np.array([weights[d] for d in model.domains], dtype=float)
    mix = solve(materialise(classify(documents, model, []), "mix-posteriors"), target / target.sum())
    # Texts are classified again rather than stored a second time beside their posteriors.
    return with_rates(classify(documents, model, keep), mix, [*keep, "n_words", "posterior"], len(model.domains)), mix


