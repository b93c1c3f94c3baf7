"""Boosted histogram trees with a Poisson loss, stopped early on validation rows and refitted with that tree count.

Features are cut into bins at quantiles; rows of equal bins are one row with their number and label sum, which is all
the loss needs. A tree grows level by level: tasks add up gradients and Hessians by (node, feature, bin), Spark sums
these cells, and the driver reads at most nodes x features x bins of them to choose the splits. Rows stay in place;
the trees so far travel to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.session import materialise, ship

CUTS = 31  # at most; bin 0 holds missing values
BINS = CUTS + 2
_CELLS = "cell int, gradient double, hessian double, weight double"


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    rate: float = 0.2
    most_trees: int = 40
    patience: int = 4
    least_rows: float = 20.0
    ridge: float = 1.0


@dataclass
class Tree:
    """A complete tree by level: a row goes left where its bin is at most the node's cut."""

    feature: list[int]
    cut: list[int]
    value: list[float]


@dataclass
class Model:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)


def binned(values: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    """Bin numbers: 0 for missing values, else 1 + how many cuts lie below the value."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(np.asarray(cuts), values, side="left")).astype(np.uint8)


def feature_cuts(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Cuts between bins: approximate quantiles of the given rows, at most ``CUTS`` a feature."""
    levels = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    numbers = rows.select(*[F.col(name).cast("double").alias(name) for name in features])
    return [sorted(set(found)) for found in numbers.approxQuantile(features, levels, 0.002)]


def _matrix(batch: pa.RecordBatch, features: Sequence[str], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    columns = [batch.column(f"__{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))]
    return np.stack([binned(c, edges) for c, edges in zip(columns, cuts)], axis=1) if columns else np.zeros((batch.num_rows, 0), np.uint8)


def _numbers(features: Sequence[str]) -> list:
    return [F.col(name).cast("double").alias(f"__{i}") for i, name in enumerate(features)]


def condensed(rows: DataFrame, features: list[str], cuts: list[list[float]], label: str, split: str) -> DataFrame:
    """Stored (split, bins, weight, total): one row for all rows of a split whose bins are equal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch, features, cuts)
            ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            bins = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(found))])
            yield pa.RecordBatch.from_arrays([batch.column("__split"), bins, batch.column("__label")], ["split", "bins", "label"])

    numbers = rows.where(F.col(label).isNotNull()).select(F.col(split).alias("__split"), F.col(label).cast("double").alias("__label"), *_numbers(features))
    kept = numbers.mapInArrow(run, "split string, bins binary, label double")
    return materialise(kept.groupBy("split", "bins").agg(F.count("*").cast("double").alias("weight"), F.sum("label").alias("total")), "tree-rows")


def _by_column(bins: pa.Array, width: int) -> np.ndarray:
    """(rows, features) matrix of stored bins, each feature in one piece."""
    _, ends, data = bins.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[bins.offset : bins.offset + len(bins) + 1]
    return np.asfortranarray(np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, width))


def node_of(tree: Tree, matrix: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row within the given level of a tree. All splits of a level are compared by column."""
    node = np.zeros(len(matrix), dtype=np.uint8 if levels < 8 else np.int64)
    for level in range(levels):
        first = 2 ** level - 1
        right = [matrix[:, tree.feature[at]] > tree.cut[at] for at in range(first, 2 * first + 1)]
        side = right[0]
        for place in range(1, len(right)):
            side = np.where(node == place, right[place], side)
        node = 2 * node + side
    return node.astype(np.int64)


def margins(model: Model, matrix: np.ndarray, depth: int) -> np.ndarray:
    total = np.full(len(matrix), model.base)
    for tree in model.trees:
        total += np.array(tree.value)[node_of(tree, matrix, depth)]
    return total


def _histograms(model: Model, growing: Tree, level: int, depth: int, train: tuple[str, ...]):
    width = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss = np.zeros((3, 2 ** level * width * BINS)), np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _by_column(batch.column("bins"), width)
            weight, total = (np.asarray(batch.column(c)) for c in ("weight", "total"))
            margin = margins(model, matrix, depth)
            mean = weight * np.exp(margin)
            learn = np.asarray(pc.is_in(batch.column("split"), value_set=pa.array(train, pa.string())))
            loss += [(mean - total * margin)[~learn].sum(), weight[~learn].sum()]
            start = node_of(growing, matrix, level)[learn] * (width * BINS)
            amounts = (mean - total)[learn], mean[learn], weight[learn]
            for f in range(width):
                cell = start + (f * BINS + matrix[:, f][learn].astype(np.int64))
                for k, amount in enumerate(amounts):
                    sums[k] += np.bincount(cell, weights=amount, minlength=sums.shape[1])
        held = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(sums[0, held], loss[0])), pa.array(np.append(sums[1, held], 0.0)), pa.array(np.append(sums[2, held], loss[1]))],
            ["cell", "gradient", "hessian", "weight"])
    return run


def histograms(rows: DataFrame, model: Model, growing: Tree, level: int, depth: int, train: tuple[str, ...]) -> tuple[np.ndarray, float]:
    """(3, nodes, features, bins) of gradient, Hessian and weight over the train rows, and the mean loss of the others."""
    cells = rows.mapInArrow(_histograms(model, growing, level, depth, train), _CELLS)
    found = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("gradient", "hessian", "weight")]).toArrow()
    cell = np.asarray(found.column("cell"))
    values = np.stack([np.asarray(found.column(c)) for c in ("gradient", "hessian", "weight")])
    out = np.zeros((3, 2 ** level * len(model.features) * BINS))
    out[:, cell[cell >= 0]] = values[:, cell >= 0]
    loss, seen = (values[k, cell < 0].sum() for k in (0, 2))
    return out.reshape(3, 2 ** level, len(model.features), BINS), loss / seen if seen else math.nan


def best_splits(sums: np.ndarray, settings: Settings) -> list[tuple[int, int, float, float]]:
    """For each node: feature, cut, and the values of both sides; a node without a useful split keeps all rows left."""
    out = []
    for node in range(sums.shape[1]):
        g, h, w = sums[:, node]  # (features, bins)
        total_g, total_h = g[0].sum(), h[0].sum()
        own = total_g ** 2 / (total_h + settings.ridge)
        left_g, left_h, left_w = (np.cumsum(side, axis=1)[:, :-1] for side in (g, h, w))
        right_g, right_h, right_w = total_g - left_g, total_h - left_h, w[0].sum() - left_w
        gain = left_g ** 2 / (left_h + settings.ridge) + right_g ** 2 / (right_h + settings.ridge) - own
        gain[(left_w < settings.least_rows) | (right_w < settings.least_rows)] = 0.0
        f, cut = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
        step = lambda a, b: float(-settings.rate * a / (b + settings.ridge))
        if gain[f, cut] <= 1e-9:
            out.append((0, BINS, step(total_g, total_h), 0.0))
        else:
            out.append((int(f), int(cut), step(left_g[f, cut], left_h[f, cut]), step(right_g[f, cut], right_h[f, cut])))
    return out


def grow(rows: DataFrame, features: list[str], cuts: list[list[float]], settings: Settings, train: tuple[str, ...], trees: int | None = None) -> tuple[Model, list[float]]:
    """Boosted model over the condensed rows of the ``train`` splits, and the loss of the other rows before each tree.

    With ``trees`` exactly so many are grown; without it, growing ends when the loss has not fallen for ``patience``
    trees, and the trees up to the smallest loss stay.
    """
    sums = rows.where(F.col("split").isin(*train)).agg(F.sum("total"), F.sum("weight")).first()
    mean = (sums[0] or 0.0) / sums[1] if sums[1] else 0.0
    model, losses = Model(features, cuts, math.log(max(mean, 1e-9))), []
    if not sums[1]:
        return model, losses
    limit = settings.most_trees if trees is None else trees
    while True:
        growing = Tree([], [], [])
        for level in range(settings.depth):
            cells, loss = histograms(rows, model, growing, level, settings.depth, train)
            if level == 0:
                losses.append(loss)
                best = int(np.nanargmin(losses)) if not math.isnan(losses[0]) else len(losses) - 1
                stale = trees is None and len(losses) - 1 - best >= settings.patience
                if stale or len(model.trees) == limit:
                    model.trees = model.trees[:best] if trees is None else model.trees
                    return model, losses
            splits = best_splits(cells, settings)
            growing.feature += [s[0] for s in splits]
            growing.cut += [s[1] for s in splits]
        growing.value = [value for s in splits for value in s[2:]]
        model.trees.append(growing)


def fit(panel: DataFrame, features: list[str], label: str = "violation_count", split: str = "split", settings: Settings = Settings()) -> Model:
    """Tree count from train rows against validation rows, then as many trees on both."""
    ship(panel.sparkSession)
    known = panel.where(F.col(split).isin("train", "val"))
    cuts = feature_cuts(known.where(F.col(split) == "train"), features)
    rows = condensed(known, features, cuts, label, split)
    tuned, _ = grow(rows, features, cuts, settings, ("train",))
    return grow(rows, features, cuts, settings, ("train", "val"), max(1, len(tuned.trees)))[0]


def predict(model: Model, rows: DataFrame, keep: list[str], name: str = "pred", settings: Settings = Settings()) -> DataFrame:
    """``keep`` columns and the predicted count."""
    ship(rows.sparkSession)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.exp(margins(model, np.asfortranarray(_matrix(batch, model.features, model.cuts)), settings.depth))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, name])

    return rows.select(*keep, *_numbers(model.features)).mapInArrow(run, schema)
