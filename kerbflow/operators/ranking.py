"""Ranks and running totals without collecting a group into one task.

Rows are range-partitioned by (group, order) and stored with their slice number; each slice is
summed on its own and shifted by the totals of the slices before it. A hot group spreads over
as many slices as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.session import materialise, slices

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def _sort(order: Order) -> list[Column]:
    return [F.col(name).asc() if up else F.col(name).desc() for name, up in order]


def running_total(df: DataFrame, order: Order, group: Sequence[str] = (), weight: str = "1",
                  name: str = "before") -> DataFrame:
    """Add the weight of all earlier rows of the group. ``order`` must be unique within a group."""
    keys = list(group) or ["all_rows"]
    base = df if group else df.withColumn("all_rows", F.lit(0))
    spread = base.repartitionByRange(slices(df.sparkSession), *[F.col(k) for k in keys], *_sort(order))
    stored = materialise(spread.withColumn("slice_no", F.spark_partition_id()), "slices")
    amount = F.expr(weight)
    earlier = (Window.unboundedPreceding, -1)
    per_slice = stored.groupBy(*keys, "slice_no").agg(F.sum(amount).alias("slice_sum"))
    across = Window.partitionBy(*keys).orderBy("slice_no").rowsBetween(*earlier)  # at most one row per slice
    shifts = per_slice.select(*keys, "slice_no", F.coalesce(F.sum("slice_sum").over(across), F.lit(0)).alias("shift"))
    inside = Window.partitionBy(*keys, "slice_no").orderBy(*_sort(order)).rowsBetween(*earlier)
    total = F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("shift")
    result = stored.join(shifts, [*keys, "slice_no"]).withColumn(name, total).drop("slice_no", "shift")
    return result if group else result.drop("all_rows")


def position(df: DataFrame, order: Order, group: Sequence[str] = (), name: str = "place") -> DataFrame:
    """1-based row number."""
    return running_total(df, order, group, "1", name).withColumn(name, F.col(name) + 1)


def average_rank(values: DataFrame, value: str, group: Sequence[str] = (), count: str = "n",
                 name: str = "mean_rank") -> DataFrame:
    """Average rank of each distinct value. ``values`` has one row per (group, value) with its count."""
    before = running_total(values, [(value, True)], group, count, "before")
    return before.withColumn(name, F.col("before") + (F.col(count) + F.lit(1)) / F.lit(2.0)).drop("before")


def percentile_rank(df: DataFrame, value: str, name: str = "pct") -> DataFrame:
    """Average rank divided by the number of rows; ties share one value.

    Rows are range-partitioned by value and row number, so a value with very many rows lies in several slices; they
    meet their rank under (slice, value), never under the value alone.
    """
    spread = df.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(slices(df.sparkSession), F.col(value), F.col("row_no"))
    stored = materialise(spread.drop("row_no").withColumn("slice_no", F.spark_partition_id()), "ranked-rows")
    counted = materialise(stored.groupBy("slice_no", value).agg(F.count("*").alias("n")), "ranked-values")
    ranks = average_rank(counted.groupBy(value).agg(F.sum("n").alias("n")), value).drop("n")
    size = counted.agg(F.sum("n")).scalar()
    placed = counted.join(ranks, value).select("slice_no", F.col(value), (F.col("mean_rank") / size).alias(name))
    return stored.join(placed, ["slice_no", value]).drop("slice_no")


def top_per_group(df: DataFrame, group: Sequence[str], order: Order, limit: int, name: str = "place") -> DataFrame:
    """First ``limit`` rows per group; tasks keep only their own best rows before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*_sort(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
