"""Dense time-series panels and strictly-past features.

Windows are partitioned by zone or cell and hold one row per day or hour of the calendar, however
many events a zone has, so a hot zone is no larger than any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import events as E
from kerbflow.functions import labels as L
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl, ratio
from kerbflow.operators.neighbours import MOORE, moore_edges
from kerbflow.operators.ranking import percentile_rank
from kerbflow.operators.zones import place
from kerbflow.session import dealt, slices

DAY_FEATURES = ["lag_1d", "lag_7d", "rolling_mean_7d", "rolling_mean_14d", "rolling_std_7d", "zone_expanding_mean",
                "dow", "month", "is_weekend", "lat", "lon"]
SPACE_FEATURES = ["neighbor_spatial_lag", "road_size_proxy"]


def daily_counts(df: DataFrame, offset_minutes: int = 330) -> DataFrame:
    """Events per (zone, local day) in the data-rich hours."""
    timed = E.with_local_time(place(df), "created_datetime", offset_minutes).where(F.hour("local_ts") < V.RICH_HOURS)
    return timed.groupBy("zone_id", F.to_date("local_ts").alias("date")).agg(F.count("*").alias("violation_count"))


def day_panel(daily: DataFrame, unit: str = "zone_id") -> DataFrame:
    """Every unit on every day of the range, missing days zero. ``daily`` should be stored."""
    ends = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.struct("a", "b")).scalar()
    days = F.sequence(ends.getField("a"), ends.getField("b"))
    spine = daily.select(unit).distinct().withColumn("date", F.explode(days))
    return spine.join(daily, [unit, "date"], "left").withColumn(
        "violation_count", F.coalesce("violation_count", F.lit(0)))


def calendar(date: Column) -> dict[str, Column]:
    return {"dow": F.weekday(date), "month": F.month(date), "is_weekend": F.when(F.weekday(date) >= 5, 1).otherwise(0)}


def day_features(panel: DataFrame, unit: str = "zone_id") -> DataFrame:
    """Lags, rolling and expanding statistics of strictly earlier days, per unit."""
    order = Window.partitionBy(unit).orderBy("date")
    count = F.col("violation_count")

    def past(days: int | None) -> Window:
        return order.rowsBetween(Window.unboundedPreceding if days is None else -days, -1)

    columns = {
        "lag_1d": F.lag(count, 1).over(order), "lag_7d": F.lag(count, 7).over(order),
        "rolling_mean_7d": F.avg(count).over(past(7)), "rolling_mean_14d": F.avg(count).over(past(14)),
        "rolling_std_7d": F.stddev_samp(count).over(past(7)), "zone_expanding_mean": F.avg(count).over(past(None)),
    }
    filled = {name: F.coalesce(value.cast("double"), dbl(0.0)) for name, value in columns.items()}
    return panel.withColumns({**filled, **calendar(F.col("date"))})


def next_day(daily: DataFrame, unit: str = "zone_id") -> DataFrame:
    """Feature row of the day after the last one, straight from the sparse counts.

    One aggregate per unit replaces the panel: zero days add nothing to sums or squares.
    """
    ends = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.struct("a", "b")).scalar()
    first, last = ends.getField("a"), ends.getField("b")
    age = F.date_diff(last, F.col("date"))  # 0 on the last day
    days = (F.date_diff(last, first) + 1).cast("double")
    count = F.col("violation_count").cast("double")

    def total(value: Column, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, value)), dbl(0.0))

    seven, fourteen = F.least(dbl(7.0), days), F.least(dbl(14.0), days)
    sums = daily.groupBy(unit).agg(
        total(count, age == 0).alias("lag_1d"), total(count, age == 6).alias("lag_7d"),
        total(count, age < 7).alias("s7"), total(count * count, age < 7).alias("q7"),
        total(count, age < 14).alias("s14"), F.sum(count).alias("s"))
    spread = F.greatest(dbl(0.0), F.col("q7") - F.col("s7") * F.col("s7") / seven)
    target = F.date_add(last, 1)
    return sums.select(
        unit, "lag_1d", "lag_7d", (F.col("s7") / seven).alias("rolling_mean_7d"), (F.col("s14") / fourteen).alias("rolling_mean_14d"),
        F.when(seven > 1, F.sqrt(spread / F.when(seven > 1, seven - 1))).otherwise(dbl(0.0)).alias("rolling_std_7d"),
        (F.col("s") / days).alias("zone_expanding_mean"), target.alias("date"),
        *[value.alias(name) for name, value in calendar(target).items()])


def neighbour_lag(panel: DataFrame, daily: DataFrame, edges: DataFrame) -> DataFrame:
    """Add the mean of the neighbours' counts one day earlier; zero without neighbours.

    Only non-zero days travel along the edges, then one equi-join brings the sums to the panel.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    sent = edges.join(daily.select(F.col("zone_id").alias("dst"), "date", "violation_count"), "dst").groupBy(
        F.col("src").alias("zone_id"), F.date_add("date", 1).alias("date")).agg(F.sum("violation_count").alias("sent"))
    joined = panel.join(sent, ["zone_id", "date"], "left").join(degree.withColumnRenamed("src", "zone_id"), "zone_id", "left")
    return joined.withColumn("neighbor_spatial_lag", ratio(F.coalesce("sent", F.lit(0)), F.coalesce("degree", F.lit(0)))).drop(
        "sent", "degree")


def whole_hour(column: str) -> Column:
    """Start of the hour of a wall-clock time, without going through the session time zone."""
    return F.timestamp_add("HOUR", F.hour(column), F.to_date(column).cast("timestamp_ntz"))


def hourly_counts(cleaned: DataFrame, min_events: int = 1) -> DataFrame:
    """Events per (cell, local hour) for cells with at least ``min_events`` events."""
    counts = cleaned.groupBy("grid_cell_id", "cell_i", "cell_j", whole_hour("local_ts").alias("ts")).agg(
        F.count("*").alias("violation_count"))
    if min_events <= 1:
        return counts
    active = counts.groupBy("grid_cell_id").agg(F.sum("violation_count").alias("n")).where(F.col("n") >= min_events)
    return counts.join(active.select("grid_cell_id"), "grid_cell_id", "left_semi")


_TASK_ROWS = 1 << 20  # panel rows that a task sorts in memory


def _panel_slices(counts: DataFrame) -> int:
    """Number of slices of cells, by the panel's rows: one sketch and two scalars over ``counts``.

    With fewer than the session's shuffle partitions, a join would shuffle the panel again.
    """
    size = counts.agg(F.approx_count_distinct("grid_cell_id").alias("cells"),
                      F.timestamp_diff("HOUR", F.min("ts"), F.max("ts")).alias("hours")).first()
    rows = size["cells"] * ((size["hours"] or 0) + 1)
    return max(slices(counts.sparkSession), -(-rows // _TASK_ROWS))


def hour_panel(counts: DataFrame) -> DataFrame:
    """Every cell in every hour of the range, missing hours zero. ``counts`` should be stored.

    Only the counts are shuffled, to slices of cells: each brings the empty hours up to the cell's next count. What
    goes on by cell stays in its slice.
    """
    ends = counts.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.struct("a", "b")).scalar()
    cells = ["grid_cell_id", "cell_i", "cell_j"]
    order = Window.partitionBy(*cells).orderBy("ts")
    counted = F.when(F.col("grid_cell_id").isNotNull(), F.col("ts"))  # a cell without id has no counts, but its hours
    placed = counts.repartition(_panel_slices(counts), "grid_cell_id").withColumn("ts", counted).withColumns({
        "first": F.row_number().over(order) == 1, "next": F.lead("ts").over(order)})
    start = F.when(F.col("first"), ends.getField("a")).otherwise(F.col("ts"))
    stop = F.when(F.col("next").isNull(), ends.getField("b")).otherwise(F.greatest("ts", F.timestamp_add("HOUR", F.lit(-1), F.col("next"))))
    spans = placed.withColumns({"start": start, "stop": stop}).where("start <= stop")
    dense = spans.withColumn("at", F.explode(F.sequence("start", "stop", F.expr("INTERVAL 1 HOUR")))).select(
        "grid_cell_id", F.col("at").alias("ts"), "cell_i", "cell_j", F.when(F.col("at") == F.col("ts"), F.col("violation_count")).alias("violation_count"))
    hour = F.hour("ts")
    return dense.withColumns({
        "violation_count": F.coalesce("violation_count", F.lit(0)), "date": F.to_date("ts"), "hour": hour,
        "day_of_week": F.weekday("ts"), "month": F.month("ts"), "is_weekend": F.when(F.weekday("ts") >= 5, 1).otherwise(0),
        "is_peak": E.is_peak(hour), "is_data_rich_hour": F.when(hour < V.RICH_HOURS, 1).otherwise(0),
    })


def cyclic(df: DataFrame) -> DataFrame:
    turns = {"hour": ("hour", 24), "dow": ("day_of_week", 7), "month": ("month", 12)}
    columns = {}
    for name, (column, period) in turns.items():
        angle = dbl(2 * math.pi) * F.col(column) / dbl(float(period))
        columns[f"sin_{name}"], columns[f"cos_{name}"] = F.sin(angle), F.cos(angle)
    return df.withColumns(columns)


def hour_features(panel: DataFrame) -> DataFrame:
    """Clock lags, rolling statistics of earlier hours and the spike ratio; one sort per cell.

    Rolling sums are differences of running sums, so a row costs the same for a day as for a week;
    counts are whole numbers, so nothing is lost in the subtraction.
    """
    order = Window.partitionBy("grid_cell_id").orderBy("ts")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    count = F.col("violation_count")
    rows = panel.withColumns({
        "run_n": F.row_number().over(order) - 1, "run_s": F.coalesce(F.sum(count).over(earlier), F.lit(0)),
        "run_q": F.coalesce(F.sum(count * count).over(earlier), F.lit(0))})
    columns = {f"lag_{n}": F.lag(count, n).over(order).cast("double") for n in (1, 24, 168)}
    for n in (24, 168):
        size = F.least("run_n", F.lit(n)).cast("double")
        total, square = (
            (F.col(c) - F.coalesce(F.lag(c, n).over(order), F.lit(0))).cast("double") for c in ("run_s", "run_q"))
        spread = F.greatest(dbl(0.0), square - ratio(total * total, size))
        columns[f"rolling_mean_{n}h"] = ratio(total, size)
        columns[f"rolling_std_{n}h"] = F.when(size > 1, F.sqrt(spread / F.when(size > 1, size - 1))).otherwise(dbl(0.0))
    rows = rows.withColumns(columns).drop("run_n", "run_s", "run_q")
    mean = F.col("rolling_mean_168h")
    return rows.withColumn("violation_rate", F.when(mean > 0, F.col("lag_1") / F.when(mean > 0, mean)).otherwise(dbl(1.0)))


def spatial_lag(panel: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean count of the present surrounding cells one hour earlier.

    Non-zero hours are sent to their eight neighbours and summed. A cell gets its sums as one array by hour, from the
    first to the last that is not empty, so a panel kept by cell meets them where it is.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in MOORE])
    sent = counts.where("ts IS NOT NULL").select("cell_i", "cell_j", "ts", "violation_count", F.explode(steps).alias("step")).groupBy(
        (F.col("cell_i") + F.col("step.i")).alias("cell_i"), (F.col("cell_j") + F.col("step.j")).alias("cell_j"),
        F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("ts")).agg(F.sum("violation_count").alias("sent"))
    cells = counts.select("grid_cell_id", "cell_i", "cell_j").distinct()
    degree = moore_edges(cells).groupBy(F.col("src").alias("grid_cell_id")).agg(F.count("*").alias("degree"))
    lists = sent.join(dealt(cells), ["cell_i", "cell_j"]).groupBy("grid_cell_id").agg(F.array_sort(F.collect_list(F.struct("ts", "sent"))).alias("list"))
    gaps = F.transform("list", lambda e, k: F.concat(F.array(e["sent"]), F.array_repeat(F.lit(0).cast("bigint"), F.coalesce(
        F.timestamp_diff("HOUR", e["ts"], F.get("list", k + 1)["ts"]).cast("int") - 1, F.lit(0)))))
    sums = lists.select("grid_cell_id", F.get("list", F.lit(0))["ts"].alias("since"), F.flatten(gaps).alias("sent"))
    joined = panel.join(dealt(degree.join(dealt(sums), "grid_cell_id", "left")), "grid_cell_id", "left")
    at = F.get("sent", F.timestamp_diff("HOUR", F.col("since"), F.col("ts")).cast("int"))
    return joined.withColumn("spatial_lag_1", ratio(F.coalesce(at, F.lit(0)), F.coalesce("degree", F.lit(0)))).drop("since", "sent", "degree")


def cell_metadata(cleaned: DataFrame) -> DataFrame:
    """Static descriptors of a cell over its whole history."""
    named = E.named_junction(F.col("junction_name"))
    return cleaned.groupBy("grid_cell_id").agg(
        F.avg("vehicle_severity").alias("mean_vehicle_severity"), F.avg("validation_trust").alias("mean_validation_trust"),
        F.avg(F.when(F.col("vehicle_severity") >= 0.6, 1.0).otherwise(0.0)).alias("heavy_vehicle_ratio"),
        F.max(F.lit(1)).alias("one"), F.sum(named).alias("named"), F.count("*").alias("n")).select(
        "grid_cell_id", "mean_vehicle_severity", "mean_validation_trust", "heavy_vehicle_ratio",
        F.when(F.col("named") > F.col("n") / 2, 1).otherwise(0).alias("junction_flag"))


def feature_matrix(cleaned: DataFrame, counts: DataFrame) -> DataFrame:
    """Hourly model input: panel, cycles, lags, spatial lag and cell descriptors.

    Lags, sums and descriptors come to the panel's slices of cells; the panel itself is not shuffled.
    """
    rows = spatial_lag(hour_features(cyclic(hour_panel(counts))), counts)
    return rows.join(dealt(cell_metadata(cleaned)), "grid_cell_id", "left")


_FILLED = ["mean_vehicle_severity", "mean_validation_trust", "heavy_vehicle_ratio", "junction_flag"]


def store_features(matrix: DataFrame, path: str) -> None:
    """Store the feature table by date; dates of the given rows replace their own partitions, others stay.

    Each slice of cells writes its own file of a date, so the widest table of the library is written without a shuffle.
    """
    matrix.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def load_split(stored: DataFrame, columns: Sequence[str], first: str | None = None, before: str | None = None) -> DataFrame:
    """Rows of one chronological split with complete lags; missing descriptors become zero.

    ``stored`` is a feature table read with its schema: only the partitions of the dates from ``first`` on and
    ``before`` the other are read, and of these the named columns and the lags.
    """
    lags = [c for c in stored.columns if c.startswith("lag_")]
    rows = stored
    if first is not None:
        rows = rows.where(F.col("date") >= F.lit(first).cast("date"))
    if before is not None:
        rows = rows.where(F.col("date") < F.lit(before).cast("date"))
    for name in lags:  # as plain predicates, so that the scan skips row groups by them
        rows = rows.where(F.col(name).isNotNull() & ~F.isnan(name))
    return rows.fillna(0, [c for c in _FILLED if c in columns]).select(*columns)


def day_split(date: Column, val_start: str, test_start: str) -> Column:
    return F.when(date < F.lit(val_start).cast("date"), "train").when(date < F.lit(test_start).cast("date"), "val").otherwise("test")


def forecast_rows(predicted: DataFrame, column: str = "pred") -> DataFrame:
    """Count, interval, percentile risk and band of each forecast."""
    value = F.greatest(F.col(column), dbl(0.0))
    ranked = percentile_rank(predicted.withColumn(column, value), column)
    error = dbl(1.96) * F.sqrt(F.col(column))
    return ranked.select(
        "zone_id", F.col(column).alias("predicted_count"), (F.col("pct") * dbl(100.0)).alias("predicted_risk"),
        L.forecast_band(F.col("pct")).alias("predicted_band"),
        F.greatest(dbl(0.0), F.col(column) - error).alias("confidence_lower"), (F.col(column) + error).alias("confidence_upper"))
