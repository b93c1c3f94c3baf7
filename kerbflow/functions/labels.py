"""Bands, tiers, proxies and explanation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbflow.functions.basics import dbl, half_up, ladder, valid_ratio


def risk_tier(score: Column) -> Column:
    """Right-closed tiers at 33, 60 and 80."""
    return ladder(
        [((score > -0.01) & (score <= 33), "LOW"), ((score > 33) & (score <= 60), "MEDIUM"),
         ((score > 60) & (score <= 80), "HIGH"), ((score > 80) & (score <= 100.01), "CRITICAL")]
    )


def tier_number(label: Column) -> Column:
    return ladder([(label == "LOW", 0), (label == "MEDIUM", 1), (label == "HIGH", 2), (label == "CRITICAL", 3)])


def served_label(score: Column) -> Column:
    return ladder([(score >= 80, "CRITICAL"), (score >= 67, "HIGH"), (score >= 34, "MEDIUM")], "LOW")


def priority(score: Column) -> Column:
    return ladder([(score >= 67, "High"), (score >= 34, "Medium")], "Low")


def force(score: Column) -> Column:
    return ladder([(score >= 67, 3), (score >= 34, 2)], 1)


def forecast_band(percentile: Column) -> Column:
    return ladder([(percentile >= 0.9, "CRITICAL"), (percentile >= 0.7, "SEVERE"), (percentile >= 0.4, "MODERATE")],
                  "MINIMAL")


def adaptation(score: Column) -> Column:
    return ladder(
        [((score > -0.01) & (score <= 40), "search_legal"), ((score > 40) & (score <= 60), "uncertain"),
         ((score > 60) & (score <= 100.01), "park_illegally")]
    )


def road_class(speed: Column) -> Column:
    return ladder([(~valid_ratio(speed), "unknown"), (speed > 40, "arterial"), (speed >= 20, "collector")], "local")


def road_rank(speed: Column) -> Column:
    kind = road_class(speed)
    return ladder([(kind == "arterial", 3), (kind == "collector", 2), (kind == "local", 1)], 0)


def road_importance(name: Column, ratio: Column) -> Column:
    """Importance of a road from the first keyword in its name and its travel ratio."""
    text = F.lower(F.coalesce(name, F.lit("")))
    named = ladder(
        [(F.contains(text, F.lit("flyover")), dbl(0.95)), (F.contains(text, F.lit("main road")), dbl(0.9)),
         (F.contains(text, F.lit("circle")), dbl(0.85)), (F.contains(text, F.lit("road")), dbl(0.75)),
         (F.contains(text, F.lit("cross")), dbl(0.6))], dbl(0.5))
    measured = F.when(F.coalesce(ratio, dbl(0.0)) != 0, F.least(dbl(1.0), dbl(0.5) + (ratio - 1.0)))
    return F.round(F.greatest(named, F.coalesce(measured, dbl(0.0))), 3)


def heavy_share_from_label(label: Column) -> Column:
    text = F.upper(F.coalesce(label, F.lit("")))

    def has(word: str) -> Column:
        return F.contains(text, F.lit(word))

    return ladder(
        [(has("MAIN ROAD") | has("DOUBLE"), dbl(0.22)), (has("BUS"), dbl(0.18)),
         (has("ROAD CROSSING") | has("TRAFFIC LIGHT"), dbl(0.12))], dbl(0.08))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", half_up(value, digits)))


def zone_story(zone_id: Column, road: Column, station: Column, score: Column, band: Column, hour: int,
               count: Column, label: Column, lane_hours: Column, ratio: Column, calibrated: Column) -> Column:
    """Explanation of one zone, made only from its own numbers."""
    measured = F.coalesce(
        F.concat(F.lit("Measured travel time is "), fixed(ratio, 2), F.lit("x free flow")),
        F.lit("No travel-time measurement"))
    checked = F.coalesce(F.concat(F.lit("; calibrated score "), fixed(calibrated, 0), F.lit("/100")), F.lit(""))
    return F.concat(
        F.lit("Zone "), zone_id, F.lit(" on "), F.coalesce(road, F.lit("this corridor")), F.lit(" ("),
        F.coalesce(station, F.lit("Unknown")), F.lit(" PS) scores "), fixed(F.coalesce(score, dbl(0.0)), 0),
        F.lit("/100, band "), F.coalesce(band, F.lit("N/A")), F.lit(f", at {hour:02d}:00. Violations: "),
        F.coalesce(count, F.lit(0)).cast("string"), F.lit(", mostly "), F.coalesce(label, F.lit("N/A")),
        F.lit("; lane-hours blocked per day: "), fixed(F.coalesce(lane_hours, dbl(0.0)), 2), F.lit(". "),
        measured, checked, F.lit("."))


def band_action(band: Column) -> Column:
    return ladder(
        [(band == "CRITICAL", "Enforce now, during the morning peak."),
         (band == "SEVERE", "Put first in the next patrol cycle."),
         (band == "MODERATE", "Plan routine patrol coverage."),
         (band == "MINIMAL", "Monitor; review if counts rise.")], "Enforce per standard protocol.")


def short_story(zone_id: Column, station: Column, score: Column, band: Column, labels: Column,
                lane_hours: Column, ratio: Column) -> Column:
    """Short variant whose last sentence depends on the band."""
    kinds = F.when(F.size(labels) > 0, F.array_join(F.slice(labels, 1, 2), ", ")).otherwise("illegal parking")
    slow = F.when(F.coalesce(ratio, dbl(1.0)) > 1.2,
                  F.concat(F.lit(" Travel time is "), fixed(ratio, 1), F.lit("x free flow."))).otherwise("")
    return F.concat(
        F.lit("Zone "), zone_id, F.lit(" ("), F.coalesce(station, F.lit("Unknown")), F.lit(" PS) scores "),
        fixed(score, 1), F.lit("/100, band "), band, F.lit(". Mainly "), kinds, F.lit("; "),
        fixed(lane_hours, 1), F.lit(" lane-hours blocked per day."), slow, F.lit(" "), band_action(band))


def calibration_story(status: Column, raw: Column, calibrated: Column, actual: Column, expected: Column,
                      where: Column) -> Column:
    """Reason text of one calibration record."""
    gap = F.concat(F.lit(" near "), where, F.lit(": measured "), fixed(actual, 2), F.lit("x, expected "),
                   fixed(expected, 2), F.lit("x"))
    moved = F.concat(fixed(raw, 0), F.lit(" to "), fixed(calibrated, 0))
    return ladder(
        [(status == "adjusted_up", F.concat(F.lit("Raised "), moved, gap)),
         (status == "adjusted_down", F.concat(F.lit("Lowered "), moved, gap)),
         (status == "validated_accurate", F.concat(F.lit("Kept "), fixed(raw, 0), gap)),
         (status == "report_only", F.concat(F.lit("Reported "), fixed(raw, 0), gap))],
        F.concat(F.lit("No measurement near "), where, F.lit("; kept "), fixed(raw, 0)))
