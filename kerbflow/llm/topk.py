"""Exact top-k inner-product search with a vector-approximation file.

Vectors become integers (floor of scale times component). Equal integer vectors are one entry with its k + 1
smallest ids, which is all that any answer can show. The approximation file keeps one byte per component, the
number of a quantisation cell, in blocks. Every query block is compared with every cell block: cells bound each
inner product from both sides, and an entry stays only if its upper bound reaches the (k + 1)-th best lower bound.
Exact vectors are then read in the order of their upper bounds, in rounds, until no unread bound reaches the kth
exact score.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of different
lengths are not compared; repeated rows of one id count once; ties go to the smaller id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.session import dealt, materialise

BLOCK_ENTRIES = 16384
BLOCK_QUERIES = 1024
CELLS = 256
CANDIDATES = "query_id long, entry long, upper double, lower double"


def integer_vector(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~bad, F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(lists: pa.ListArray, dimension: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), dimension)


def bounds(queries: np.ndarray, codes: np.ndarray, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products with vectors known only by their cells [low + c*width, low + (c+1)*width - 1]."""
    corner = queries @ (low + codes.T * width)
    slack = (width - 1) * queries
    return corner + np.minimum(slack, 0).sum(axis=1)[:, None], corner + np.maximum(slack, 0).sum(axis=1)[:, None]


def _compare(low: float, width: float, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dimension = batch.column("dimension")[row].as_py()
                asked, known = batch.column("asked")[row].values, batch.column("known")[row].values
                queries = _matrix(asked.field("vector"), dimension).astype(np.float64)
                codes = _matrix(known.field("cells"), dimension).astype(np.float64)
                ids, entries = np.asarray(asked.field("query_id")), np.asarray(known.field("entry"))
                for first in range(0, len(queries), 128):
                    lower, upper = bounds(queries[first : first + 128], codes, low, width)
                    place = max(0, lower.shape[1] - keep)
                    floor = np.partition(lower, place, axis=1)[:, place] if lower.shape[1] >= keep else np.full(len(lower), -np.inf)
                    q, e = np.nonzero(upper >= floor[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first + q]), pa.array(entries[e]), pa.array(upper[q, e]), pa.array(lower[q, e])], ["query_id", "entry", "upper", "lower"])
    return run


def _numbered(df: DataFrame, key: str, size: int, packed: Column, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, dealt by hash, and their number."""
    blocks = max(1, -(-df.count() // size))
    return df.groupBy("dimension", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(f"{name}_block")).agg(F.collect_list(packed).alias(name)), blocks


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, first_round: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row with ``is_query``.

    ``first_round`` times k entries are read exactly for a query in the first round, twice as many in each next one.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), integer_vector(vector_column, scale).alias("vector"), is_query.alias("asks")).where("vector IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id"])
    rows = materialise(rows.withColumn("dimension", F.size("vector")), "topk-rows")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector", "dimension")
    # The row_number filter is applied before the shuffle too, so a vector with very many ids sends k + 1 a task.
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    entries = materialise(ranked.groupBy("vector").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("dimension").alias("dimension")), "topk-entries")

    low, high = entries.select(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    low, high = low or 0, high or 0
    width = -(-(high - low + 1) // CELLS)
    cells = F.transform("vector", lambda x: F.floor((x - low) / width).cast("short"))
    known, blocks = _numbered(entries, "entry", BLOCK_ENTRIES, F.struct("entry", cells.alias("cells")), "known")
    asked, _ = _numbered(queries, "query_id", BLOCK_QUERIES, F.struct("query_id", "vector"), "asked")
    # Each block of the stated query set meets each block of cells once.
    pairs = asked.withColumn("known_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt(known), ["dimension", "known_block"])
    found = pairs.select("dimension", "asked", "known").mapInArrow(_compare(float(low), float(width), k + 1), CANDIDATES)
    found = materialise(found, "topk-bounded")

    by_query = Window.partitionBy("query_id")
    floor = found.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("lower"), "entry"))).where(F.col("place") <= k + 1)
    floor = floor.groupBy("query_id").agg(F.when(F.count(F.lit(1)) > k, F.min("lower")).otherwise(float("-inf")).alias("floor"))
    open_ = found.join(dealt(floor), "query_id").where("upper >= floor").select("query_id", "entry", "upper")
    open_ = materialise(open_.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("upper"), "entry"))), "topk-candidates")

    exact, done, reach, best = None, 0, first_round * k, None
    while True:
        batch = open_.where((F.col("place") > done) & (F.col("place") <= reach))
        if best is not None:
            certain = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            batch = batch.join(dealt(certain), "query_id", "left").where("kth IS NULL OR upper >= kth").drop("kth")
            batch = materialise(batch, "topk-round")
            if batch.isEmpty() and open_.where(F.col("place") > reach).isEmpty():
                break
        score = F.aggregate(F.zip_with("vector", "other", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
        read = batch.join(dealt(queries.select("query_id", F.col("vector").alias("other"))), "query_id").join(dealt(entries.select("entry", "vector", "ids")), "entry")
        read = read.select("query_id", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        exact = read if exact is None else best.unionByName(read)
        rank = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))
        best = materialise(exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "topk-best")
        done, reach = reach, 2 * reach
        if open_.where(F.col("place") > done).isEmpty():
            break
    rank = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score")
