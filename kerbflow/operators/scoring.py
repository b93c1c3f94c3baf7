"""Impact score of each (zone, bucket): components, weights, lane-hours, bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import geo as G
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import bounded, dbl, degradation, half_up, moving_label, valid_ratio
from kerbflow.operators.zones import maxima


def one_row(df: DataFrame, *columns: str) -> list[Column]:
    """Columns of a one-row table as scalar subqueries; no join and no collect."""
    packed = df.select(F.struct(*columns)).scalar()
    return [packed.getField(name) for name in columns]


def component_columns(maxes: Mapping[str, Column]) -> dict[str, Column]:
    lane = (F.col("main_road_count") + F.lit(2) * F.col("double_park_count")).cast("double")
    boost = F.when(F.col("has_named_junction") == 1, dbl(1.5)).otherwise(dbl(0.5))
    junction = F.col("junction_violation_count").cast("double") / F.greatest(maxes["max_junction_load"], dbl(1.0))
    measured = valid_ratio(F.col("travel_time_ratio"))
    mean = F.col("mean_vehicle_obstruction")
    return {
        "lane_blockage": bounded(lane / F.greatest(maxes["max_lane_load"], dbl(1.0))),
        "intersection_impact": bounded(junction * boost),
        "traffic_degradation": F.when(measured, degradation(F.col("travel_time_ratio"))).otherwise(
            dbl(V.DEFAULT_DEGRADATION)),
        "access_blockage": bounded(
            F.col("access_violation_count").cast("double") / F.greatest(maxes["max_access_count"], dbl(1.0))),
        "vehicle_size": bounded(mean / F.greatest(maxes["max_mean_obstruction"], dbl(1e-9))),
        "severity": bounded(mean / dbl(2.0)),
        "is_defaulted": F.when(measured, 0).otherwise(1),
    }


def components(table: DataFrame, maxes: DataFrame | None = None) -> DataFrame:
    """Add the five components, severity and the defaulted flag.

    ``table`` should be stored (see ``session.materialise``): the maxima read it once more.
    """
    names = ["max_lane_load", "max_junction_load", "max_access_count", "max_mean_obstruction"]
    values = one_row(maxima(table) if maxes is None else maxes, *names)
    return table.withColumns(component_columns(dict(zip(names, values))))


def components_by_level(table: DataFrame) -> DataFrame:
    """Components normalised within each zone level (a handful of groups)."""
    maxes = maxima(table, ("level",))
    names = ["max_lane_load", "max_junction_load", "max_access_count", "max_mean_obstruction"]
    joined = table.join(F.broadcast(maxes), "level")  # one row per level: size fixed by the level list
    return joined.withColumns(component_columns({name: F.col(name) for name in names})).drop(*names)


def weighted_sum(weights: Mapping[str, float | Column]) -> Column:
    total = None
    for name, weight in weights.items():
        weight = weight if isinstance(weight, Column) else dbl(weight)
        term = weight * F.col(name)
        total = term if total is None else total + term
    return total


def impact(weights: Mapping[str, float | Column] = V.IMPACT_WEIGHTS) -> Column:
    return bounded(dbl(100.0) * weighted_sum(weights), 0.0, 100.0)


def lane_hours() -> Column:
    main, double, junction = (F.col(c) for c in ("main_road_count", "double_park_count", "junction_violation_count"))
    other = F.greatest(F.col("total_records") - main - double - junction, F.lit(0))
    return main * dbl(0.5) + double * dbl(1.0) + junction * dbl(0.75) + other * dbl(0.25)


def with_centre(table: DataFrame, level: int = 9) -> DataFrame:
    step = dbl(G.zone_step(level))
    return table.withColumns({
        "lat": (F.col("zi").cast("double") + dbl(0.5)) * step,
        "lon": (F.col("zj").cast("double") + dbl(0.5)) * step,
    })


def score(table: DataFrame, weights: Mapping[str, float | Column] = V.IMPACT_WEIGHTS,
          overrides: DataFrame | None = None) -> DataFrame:
    """Full breakdown. ``overrides`` (zone_id, degradation) replaces the ratio-based component."""
    rated = components(table)
    if overrides is not None:
        extra = overrides.select("zone_id", F.col("degradation").alias("override"))
        rated = rated.join(extra, "zone_id", "left").withColumns({
            "traffic_degradation": F.coalesce(bounded(F.col("override")), F.col("traffic_degradation")),
            "is_defaulted": F.when(F.col("override").isNotNull(), 0).otherwise(F.col("is_defaulted")),
        }).drop("override")
    scored = with_centre(rated).withColumns({"congestion_impact": impact(weights), "lane_hours": lane_hours()})
    return scored.withColumn("impact_band", moving_label(half_up(F.col("congestion_impact"), 9)))


def nested(scored: DataFrame, weights: Mapping[str, float] = V.IMPACT_WEIGHTS) -> DataFrame:
    """Contract shape: components as a struct, weights as a map."""
    parts = [*V.IMPACT_WEIGHTS, "severity"]
    pairs = [F.lit(item) for entry in weights.items() for item in entry]
    return scored.select(
        "zone_id", "time_bucket", "lat", "lon", "congestion_impact", "impact_band",
        F.struct(*parts).alias("components"), F.create_map(*pairs).alias("weights"),
        F.col("lane_hours").alias("estimated_lane_hours_blocked"), "total_records", "top_violations", "station",
        "travel_time_ratio", F.col("is_defaulted").alias("is_traffic_degradation_defaulted"))
