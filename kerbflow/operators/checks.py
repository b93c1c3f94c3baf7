"""Assertion queries: each counts the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V


def displacement(result: DataFrame) -> DataFrame:
    before, after, kind = F.col("original_risk"), F.col("adjusted_risk"), F.col("spillover_type")
    return result.agg(
        F.count_if((after < 0) | (after > 100)).alias("out_of_range"),
        F.count_if((kind == "patrolled") & (after > before)).alias("patrolled_up"),
        F.count_if((kind == "neighbor_1") & (after < before)).alias("neighbour_down"))


def contract(nested: DataFrame) -> DataFrame:
    """Rules of the breakdown record, one row per rule."""
    parts = [F.col(f"components.{name}") for name in [*V.IMPACT_WEIGHTS, "severity"]]
    outside = None
    for part in parts:
        test = part.isNull() | (part < 0) | (part > 1)
        outside = test if outside is None else outside | test
    weight_sum = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda total, w: total + w)
    score = F.col("congestion_impact")
    rules = {
        "components_in_unit_range": outside,
        "score_in_range": (score < 0) | (score > 100),
        "counts_not_negative": (F.col("total_records") < 0) | (F.col("estimated_lane_hours_blocked") < 0),
        "weights_sum_to_one": F.abs(weight_sum - 1.0) > 1e-9,
        "label_known": ~F.col("impact_band").isin("MINIMAL", "MODERATE", "SEVERE", "CRITICAL"),
    }
    counts = nested.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return counts.unpivot([], list(rules), "rule", "broken")


def unknown_values(found: DataFrame, column: str, known: DataFrame, source: str) -> DataFrame:
    """How many non-null values of ``column`` appear in the source table, and how many do not."""
    used = found.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    seen = known.where(F.col(source).isNotNull()).select(F.col(source).alias("value"), F.lit(1).alias("hit")).distinct()
    return used.join(seen, "value", "left").agg(
        F.count_if(F.col("hit") == 1).alias("known"), F.count_if(F.col("hit").isNull()).alias("unknown"))
