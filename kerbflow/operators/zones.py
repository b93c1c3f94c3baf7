"""Zone placement and the (zone, time bucket) aggregate behind every score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from kerbflow.functions import events as E
from kerbflow.functions import geo as G
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import clean_key, dbl

TOP_LABELS = 5


def place(df: DataFrame) -> DataFrame:
    """Keep rows with coordinates and add the zone indices and id at level 9."""
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    usable = df.where(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
    placed = usable.withColumns({"zi": G.lattice(lat, V.ZONE_STEP), "zj": G.lattice(lon, V.ZONE_STEP)})
    return placed.withColumn("zone_id", G.zone_key(F.col("zi"), F.col("zj")))


def prepare(df: DataFrame, offset_minutes: int = 330, late: bool = False) -> DataFrame:
    """Per-row fields of the zone path; rows after the data-rich hours are dropped, or kept with a null bucket."""
    timed = E.with_local_time(place(df), "created_datetime", offset_minutes)
    bucket = E.hour_label(F.hour("local_ts"), V.IMPACT_BUCKETS)
    is_array = isinstance(df.schema["violation_type"].dataType, T.ArrayType)
    columns = {
        "time_bucket": bucket,
        "labels": E.label_list("violation_type", is_array),
        "weight": E.obstruction(E.trusted_vehicle(F.col("updated_vehicle_type"), F.col("vehicle_type"))),
        "named": E.named_junction(F.col("junction_name")),
        "station": E.station_name(F.col("police_station")),
    }
    rows = timed.withColumns(columns)
    return rows if late else rows.where(F.col("time_bucket").isNotNull())


def fact_base(df: DataFrame) -> DataFrame:
    """The facts condensed once for everything that is asked by zone: late hours included, with the signal's sums."""
    return prepare(df, late=True).groupBy("zone_id", "zi", "zj", "time_bucket", "station", "labels").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("named").alias("named"),
        F.sum("signal").alias("signal"), F.count("signal").alias("signals"))


def condense(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct (keys, bucket, station, labels) with sums.

    This is the only shuffle over fact rows. Copies collapse on the map side, so a zone with
    a third of all rows sends one row per combination and task.
    """
    return prepared.groupBy(*keys, "time_bucket", "station", "labels").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("named").alias("named"))


def _aggregate_condensed(condensed: DataFrame, keys: list[str]) -> DataFrame:
    group = [*keys, "time_bucket"]
    flags = {
        "main": E.any_of("labels", [V.MAIN_ROAD_LABEL]),
        "double": E.any_of("labels", [V.DOUBLE_PARK_LABEL]),
        "junction": E.any_of("labels", V.JUNCTION_LABELS),
        "access": E.any_of("labels", V.ACCESS_LABELS),
    }
    with_rollup = condensed.withColumn(
        "time_bucket", F.explode(F.array(F.col("time_bucket"), F.lit(V.ALL_DAY))))
    facet = F.expr("""explode(concat(
        array(named_struct('kind', 'total', 'value', ''), named_struct('kind', 'station', 'value', station)),
        transform(labels, item -> named_struct('kind', 'label', 'value', item))))""").alias("facet")
    long = with_rollup.select(*group, "n", "w", "named", *[flag.alias(name) for name, flag in flags.items()], facet)
    counted = (
        long.where("facet.value IS NOT NULL")
        .groupBy(*group, F.col("facet.kind").alias("kind"), F.col("facet.value").alias("value"))
        .agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("named").alias("named"),
             *[F.sum(F.col("n") * F.col(name)).alias(name) for name in flags]))
    order = Window.partitionBy(*group, "kind").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP_LABELS)

    def of_total(name: str) -> Column:
        return F.max(F.when(F.col("kind") == "total", F.col(name)))

    labels = F.collect_list(F.when(F.col("kind") == "label", F.struct("place", "value")))
    return ranked.groupBy(*group).agg(
        of_total("n").alias("total_records"),
        of_total("main").alias("main_road_count"),
        of_total("double").alias("double_park_count"),
        of_total("junction").alias("junction_violation_count"),
        of_total("access").alias("access_violation_count"),
        (of_total("w") / of_total("n")).alias("mean_vehicle_obstruction"),
        of_total("named").alias("has_named_junction"),
        F.max(F.when((F.col("kind") == "station") & (F.col("place") == 1), F.col("value"))).alias("station"),
        F.transform(F.array_sort(labels), lambda item: item["value"]).alias("top_violations"),
    )


def aggregate(prepared: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """Counts, mean obstruction, mode station and top labels per (zone, bucket) and per zone.

    The day rollup is built from the condensed rows, not from a second pass over the facts.
    """
    keys = ["zone_id", "zi", "zj"]
    table = _aggregate_condensed(condense(prepared, keys), keys)
    return attach_ratio(table, ratios)


def aggregate_base(base: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """The same table from the condensed facts."""
    return attach_ratio(_aggregate_condensed(base.where("time_bucket IS NOT NULL"), ["zone_id", "zi", "zj"]), ratios)


def attach_ratio(table: DataFrame, ratios: DataFrame | None) -> DataFrame:
    """Left lookup of the travel ratio; zones without one keep null."""
    if ratios is None:
        return table.withColumn("travel_time_ratio", F.lit(None).cast("double"))
    return table.join(ratios.select("zone_id", "travel_time_ratio"), "zone_id", "left")


def aggregate_levels(prepared: DataFrame, levels: tuple[int, ...] = (5, 7, 8, 9)) -> DataFrame:
    """The same aggregate at several zone levels, rolled up from one condensed level-9 table."""
    base = condense(prepared, ["zi", "zj"])
    spread = base.withColumn("level", F.explode(F.array(*[F.lit(level) for level in levels])))
    factor = F.lit(None).cast("double")
    for level in levels:
        factor = F.when(F.col("level") == level, dbl(V.ZONE_FACTORS[level])).otherwise(factor)
    up = spread.withColumns({
        "zi": F.floor(F.col("zi") / factor).cast("bigint"),
        "zj": F.floor(F.col("zj") / factor).cast("bigint"),
    })
    name = F.concat_ws("_", F.concat(F.lit("z"), F.col("level").cast("string")),
                       F.col("zi").cast("string"), F.col("zj").cast("string"))
    return _aggregate_condensed(up.withColumn("zone_id", name), ["level", "zone_id", "zi", "zj"])


def maxima(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest loads over all entries, rollups included; zeros for an empty table."""
    load = F.col("main_road_count") + F.lit(2) * F.col("double_park_count")
    parts = {
        "max_lane_load": F.max(load), "max_junction_load": F.max("junction_violation_count"),
        "max_access_count": F.max("access_violation_count"), "max_mean_obstruction": F.max("mean_vehicle_obstruction"),
    }
    values = [F.coalesce(value.cast("double"), dbl(0.0)).alias(name) for name, value in parts.items()]
    return table.groupBy(*keys).agg(*values) if keys else table.agg(*values)


def mode(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct(-F.col("n"), F.col(column)))
    return counted.groupBy(*keys).agg(best.getField(column).alias(name))


def top_values(df: DataFrame, keys: list[str], array: str, limit: int = TOP_LABELS) -> DataFrame:
    """Most frequent array items per group with their counts, counted before ranking."""
    counted = (df.select(*keys, F.explode(array).alias("item"))
               .groupBy(*keys, "item").agg(F.count("*").alias("n")))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("item"))
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def rekey_last(context: DataFrame, level: int = 9) -> DataFrame:
    """Re-key context rows by their coordinates; the last source row of a cell wins."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    usable = context.where(lat.between(-90, 90) & lon.between(-180, 180))
    step = G.zone_step(level)
    key = G.zone_key(G.lattice(lat, step), G.lattice(lon, step), level)
    keep = [c for c in context.columns if c not in ("zone_id", "source_order")]
    row = F.struct("source_order", F.col("zone_id").alias("original_zone_id"), *keep)
    latest = usable.groupBy(key.alias("zone_id")).agg(F.max_by(row, F.col("source_order")).alias("row"))
    return latest.select("zone_id", "row.original_zone_id", *[f"row.{c}" for c in keep])


def rekey_mean(context: DataFrame, level: int = 9) -> DataFrame:
    """Ratio per cell from coordinates; several rows in a cell are averaged."""
    from kerbflow.functions.basics import valid_ratio

    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    step = G.zone_step(level)
    key = G.zone_key(G.lattice(lat, step), G.lattice(lon, step), level)
    usable = context.where(lat.isNotNull() & lon.isNotNull() & valid_ratio(F.col("travel_time_ratio")))
    return usable.groupBy(key.alias("zone_id")).agg(F.avg("travel_time_ratio").alias("travel_time_ratio"))


def clean_legacy(df: DataFrame, offset_minutes: int = 330) -> DataFrame:
    """Cleaned event table of the lattice path: time parts, pincode, cell, severity, trust."""
    timed = E.with_local_time(df, "created_datetime", offset_minutes).where(F.col("local_ts").isNotNull())
    hour, day = F.hour("local_ts"), F.weekday("local_ts")
    vehicle = clean_key(E.trusted_vehicle(F.col("updated_vehicle_type"), F.col("vehicle_type")))
    cell_i, cell_j = G.lattice(F.col("latitude"), V.GRID_STEP), G.lattice(F.col("longitude"), V.GRID_STEP)
    cleaned = timed.withColumns({
        "hour": hour, "day_of_week": day, "month": F.month("local_ts"), "date": F.to_date("local_ts"),
        "is_weekend": F.when(day >= 5, 1).otherwise(0), "is_peak": E.is_peak(hour),
        "time_bucket": E.hour_label(hour, V.LEGACY_BUCKETS),
        "pincode": E.pincode(F.col("location")),
        "cell_i": cell_i, "cell_j": cell_j,
        "vehicle_type_final": vehicle, "vehicle_severity": E.severity(vehicle),
        "validation_status_clean": F.lower(F.trim("validation_status")),
        "validation_trust": E.trust(F.col("validation_status")),
        "primary_violation": E.first_label(F.col("violation_type")),
    })
    cleaned = cleaned.withColumns({
        "grid_cell_id": G.cell_id(F.col("cell_i"), F.col("cell_j")),
        "grid_lat": G.cell_centre(F.col("cell_i"), V.GRID_STEP),
        "grid_lon": G.cell_centre(F.col("cell_j"), V.GRID_STEP),
    })
    return cleaned.drop(*V.UNUSED_COLUMNS)
