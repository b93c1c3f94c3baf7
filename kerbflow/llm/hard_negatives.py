"""Hard negatives by a vertical scan of vectors (BOND).

Blocks of rows are stored by dimension. An anchor reads a block's dimensions in the order of its own descending
magnitudes; the partial inner products and what the unread dimensions can still add (least and largest value of each
dimension in the block) bound every score, and rows that cannot matter leave the candidate bitmap.

1. Positives: the best rows of the anchor's own label. A row stays while its upper bound reaches the k-th lower bound.
2. Negatives: each positive gives a window of scores. A row of another label stays while its bounds meet some window
   and its upper bound reaches the n-th lower bound of the rows certainly inside that window.

Every block of anchors (the stated query set) meets every block of rows; a block reports k or n rows an anchor or
window, and the blocks' lists are merged. Blocks are dealt by id, so that no label, copy or hot vector makes one
larger.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null label or id, take no
part, nor do vectors whose squared integer length is 2**53 or more (their scores would not be exact); rows of one id count
once (that of the smallest label, then vector); vectors of different lengths are not compared; copies under different
ids are rows like any other; ties go to the smaller id; an anchor without positives, or whose positives leave an
empty window (as negative scores do), gives no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.session import dealt, materialise, slices

BLOCK_CELLS = 1 << 20  # components in a block of rows: 8 MB
BLOCK_ANCHORS = 256
STEP = 16  # dimensions read between two looks at the bounds
BLOCK = "dimension int, block int, ids array<long>, labels array<long>, columns array<double>"


def integer_vector(column: str, scale: int) -> Column:
    """floor(scale * x) of each component as double; null where the vector takes no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor saturates at 64 bits; such a vector's length is beyond the limit in any case.
    whole = F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("double"))
    length = F.aggregate(whole, F.lit(0.0), lambda total, x: total + x * x)
    return F.when(F.col(column).isNotNull() & ~bad & (length < float(1 << 53)), whole)


def _vertical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block become its ids, its labels and one run of values a dimension."""
    for batch in batches:
        for row in range(batch.num_rows):
            dimension, held = batch.column("dimension")[row].as_py(), batch.column("held")[row].values
            matrix = np.asarray(held.field("vector").flatten(), dtype=np.float64).reshape(len(held), dimension)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dimension], pa.int32()), batch.column("block").slice(row, 1), *(pa.array([np.asarray(held.field(c))], pa.list_(pa.int64())) for c in ("id", "label")), pa.array([np.ascontiguousarray(matrix.T).ravel()], pa.list_(pa.float64()))],
                ["dimension", "block", "ids", "labels", "columns"])


def scan(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows that no bound could rule out.

    ``columns`` is (dimension, rows), ``low`` and ``high`` its extremes by dimension, ``alive`` the candidate bitmap.
    ``prune(lower, upper)`` tells which rows can still matter.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    least, most = np.minimum(anchor * low, anchor * high)[order], np.maximum(anchor * low, anchor * high)[order]
    ahead_low, ahead_high = (np.append(np.cumsum(side[::-1])[::-1], 0.0) for side in (least, most))
    places = np.flatnonzero(alive)
    partial = np.zeros(len(places))
    for first in range(0, len(order), STEP):
        if not len(places):
            break
        for d in order[first : first + STEP]:
            partial += anchor[d] * (columns[d] if len(places) == columns.shape[1] else columns[d][places])
        last = min(first + STEP, len(order))
        stay = prune(partial + ahead_low[last], partial + ahead_high[last])
        if not stay.all():
            places, partial = places[stay], partial[stay]
    return places, partial


def best_rule(k: int):
    """Rows whose upper bound reaches the k-th largest lower bound."""

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return np.ones(len(lower), bool) if len(lower) <= k else upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
    return prune


def window_rule(windows: list[tuple[int, int]], n: int):
    """Rows that can be among the n best of some window [least, most] of scores."""
    bottom, top = min(w[0] for w in windows), max(w[1] for w in windows)

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        near = np.flatnonzero((upper >= bottom) & (lower <= top))
        stay = np.zeros(len(lower), bool)
        lower, upper = lower[near], upper[near]
        keep = np.zeros(len(near), bool)
        for least, most in windows:
            certain = lower[(lower >= least) & (upper <= most)]
            floor = np.partition(certain, len(certain) - n)[len(certain) - n] if len(certain) >= n else least
            keep |= (upper >= floor) & (lower <= most)
        stay[near] = keep
        return stay
    return prune


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, and ids, labels, columns and extremes of the block they meet, for each row."""
    for row in range(batch.num_rows):
        dimension = batch.column("dimension")[row].as_py()
        ids, labels = (np.asarray(batch.column(c)[row].values) for c in ("ids", "labels"))
        columns = np.asarray(batch.column("columns")[row].values).reshape(dimension, len(ids))
        extremes = (columns.min(axis=1), columns.max(axis=1)) if dimension else (np.zeros(0), np.zeros(0))
        yield batch.column("asked")[row].values, ids, labels, columns, *extremes


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, ids, labels, columns, low, high in _blocks_of(batch):
                anchors, own, vectors = np.asarray(asked.field("id")), np.asarray(asked.field("label")), asked.field("vector")
                found = []
                for i, (anchor, label) in enumerate(zip(anchors, own)):
                    places, scores = scan(np.asarray(vectors[i].values, dtype=np.float64), columns, low, high, (labels == label) & (ids != anchor), best_rule(k))
                    first = _first(ids[places], scores, k)
                    found.append((np.full(len(first), anchor), ids[places][first], scores[first]))
                a, p, s = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(p), pa.array(s.astype(np.int64))], ["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, ids, labels, columns, low, high in _blocks_of(batch):
                anchors, own, vectors = np.asarray(asked.field("id")), np.asarray(asked.field("label")), asked.field("vector")
                found = [(np.zeros(0, np.int64),) * 5]
                for i, (anchor, label) in enumerate(zip(anchors, own)):
                    windows = [(w["positive_id"], w["positive_score"], w["least"], w["most"]) for w in asked.field("windows")[i].as_py()]
                    rule = window_rule([w[2:] for w in windows], n)
                    places, scores = scan(np.asarray(vectors[i].values, dtype=np.float64), columns, low, high, labels != label, rule)
                    for positive, score, least, most in windows:
                        inside = (scores >= least) & (scores <= most)
                        first = _first(ids[places][inside], scores[inside], n)
                        size = len(first)
                        found.append((np.full(size, anchor), np.full(size, positive), np.full(size, score), ids[places][inside][first], scores[inside][first].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def _meet(asked: DataFrame, known: DataFrame, blocks: int) -> DataFrame:
    """Every block of anchors beside every block of rows of its dimension.

    The pairs are dealt over a stated number of tasks: by their bytes alone they would fall into a few. Where blocks are
    fewer than tasks, the anchors that meet a block are dealt too.
    """
    tasks = 4 * slices(asked.sparkSession)
    anchors = max(1, -(-asked.count() // BLOCK_ANCHORS))
    hands = max(1, min(anchors, -(-tasks // blocks)))
    keys = ["dimension", "block", "hand"]
    packed = asked.groupBy("dimension", F.pmod(F.xxhash64("id"), F.lit(anchors)).alias("part")).agg(F.collect_list(F.struct(*[c for c in asked.columns if c != "dimension"])).alias("asked"))
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("hand", F.pmod("part", F.lit(hands)).cast("int"))
    known = known.withColumn("hand", F.explode(F.sequence(F.lit(0), F.lit(hands - 1))))
    return packed.repartition(tasks, *keys).join(dealt(known.repartition(tasks, *keys)), keys).select("dimension", "asked", "ids", "labels", "columns")


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
         id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Negatives score between ``low_percent`` and ``high_percent`` of the positive's score. ``label`` is an integer column.
    """
    valid = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), integer_vector(vector_column, scale).alias("vector"), is_anchor.alias("asks"))
    valid = valid.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    one = valid.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("row")).select("id", "row.*").withColumn("dimension", F.size("vector"))
    one = materialise(one, "negatives-rows")
    cells = one.agg(F.sum("dimension")).first()[0] or 0
    blocks = max(1, -(-cells // BLOCK_CELLS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    known = one.groupBy("dimension", block).agg(F.collect_list(F.struct("id", "label", "vector")).alias("held")).mapInArrow(_vertical, BLOCK)
    known = materialise(known, "negatives-blocks")

    anchors = one.where("asks").select("dimension", "id", "label", "vector")
    near = _meet(anchors, known, blocks).mapInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    least = -F.expr(f"(-{low_percent} * positive_score - pmod(-{low_percent} * positive_score, 100)) div 100")
    most = F.expr(f"({high_percent} * positive_score - pmod({high_percent} * positive_score, 100)) div 100")
    windows = near.withColumn("least", least).withColumn("most", most).where("least <= most")
    windows = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score", "least", "most")).alias("windows"))
    asked = materialise(anchors.join(dealt(windows), F.col("id") == F.col("anchor_id")).drop("anchor_id"), "negatives-windows")

    found = _meet(asked, known, blocks).mapInArrow(_negatives(negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
