"""Profiling queries over the event table: completeness, distributions, repeats, latency, indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import events as E
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl, lookup, quoted, ratio
from kerbflow.operators.ranking import position
from kerbflow.operators.selection import counted_values, quantiles_of_counts
from kerbflow.session import materialise


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls and distinct values per column.

    Values are counted per (column, value) first, so frequent values collapse before the shuffle and
    no column is gathered in one place.
    """
    text = df.select(*[F.col(name).cast("string").alias(name) for name in columns])
    long = text.unpivot([], list(columns), "column", "value")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"))


def share(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows and percentage per key; the total comes from the stored counts, not from a second scan."""
    counted = materialise(df.groupBy(*keys).agg(F.count("*").alias("n")), "counts")
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("pct", F.col("n").cast("double") / total * dbl(100.0))


def label_counts(df: DataFrame) -> DataFrame:
    """Rows that carry each label; rows are condensed per label list before the lists are opened."""
    lists = df.groupBy("labels").agg(F.count("*").alias("n"))
    return lists.select(F.explode(F.array_distinct("labels")).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))


def label_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.size("labels").alias("labels_per_row")).agg(F.count("*").alias("n"))


def label_combinations(df: DataFrame) -> DataFrame:
    return df.groupBy(F.array_join("labels", " + ").alias("combination")).agg(F.count("*").alias("n"))


def vehicle_corrections(df: DataFrame) -> DataFrame:
    changed = df.where(E.not_missing(F.col("updated_vehicle_type"), V.MISSING_WORDS)
                       & (F.col("updated_vehicle_type") != F.col("vehicle_type")))
    return changed.groupBy("vehicle_type", "updated_vehicle_type").agg(F.count("*").alias("n"))


def repeat_histogram(df: DataFrame) -> DataFrame:
    """How many vehicles have how many records."""
    per = df.groupBy("vehicle_number").agg(F.count("*").alias("records"))
    return per.groupBy("records").agg(F.count("*").alias("vehicles"))


def prior_counts(df: DataFrame, spans: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Records of the same vehicle on the 7, 30 and 90 days before each of its active days.

    Counted per (vehicle, day) first: a window holds at most one row per calendar day.
    """
    daily = df.groupBy("vehicle_number", F.to_date("local_ts").alias("date")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("vehicle_number").orderBy(F.unix_date("date"))
    return daily.withColumns({
        f"prior_{days}d": F.coalesce(F.sum("n").over(order.rangeBetween(-days, -1)), F.lit(0)) for days in spans})


def missing_by(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNull()).groupBy(key).agg(F.count("*").alias("n"))


def status_by_month(df: DataFrame) -> DataFrame:
    """Rows per month and status, whatever statuses there are."""
    month = F.substring(F.to_date("local_ts").cast("string"), 1, 7).alias("month")
    return df.groupBy(month, F.coalesce("validation_status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def latency(df: DataFrame, pairs: dict[str, str], start: str = "created_datetime", levels: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Median and 90th percentile of delays in hours, and how many are negative."""
    def micros(name: str) -> Column:
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(name))

    delays = F.array(*[F.struct(F.lit(name).alias("delay"), ((micros(column) - micros(start)) / dbl(3.6e9)).alias("hours"))
                       for name, column in pairs.items()])
    long = df.select(F.explode(delays).alias("d")).select("d.*")
    counted = counted_values(long, "hours", ["delay"])  # the only read of the rows
    counts = counted.groupBy("delay").agg(
        F.sum("copies").alias("n"), F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("copies"))), F.lit(0)).alias("negative"))
    wide = quantiles_of_counts(counted, levels, ["delay"]).groupBy("delay").agg(*[
        F.max(F.when(F.col("level") == level, F.col("quantile"))).alias(f"q{round(level * 100)}_hours") for level in levels])
    return counts.join(wide, "delay")


def label_severity(labels: str = "labels") -> Column:
    """Highest documented severity among a row's labels; other labels weigh 1."""
    cases = " ".join(f"WHEN {quoted(name)} THEN {value!r}D" for name, value in V.LABEL_SEVERITY.items())
    return F.expr(f"coalesce(array_max(transform({labels}, item -> CASE item {cases} ELSE 1D END)), 1D)")


def proxy_index(prepared: DataFrame, peak: dict[str, float] | None = None) -> DataFrame:
    """Documented seven-part risk proxy per (zone, bucket), min-max scaled to 0-100 with bands."""
    from kerbflow.operators.scoring import one_row

    peak = peak or {"morning_peak": 1.0, "midday": 0.8, "afternoon": 0.6, "night": 0.3}
    exposed = F.greatest(F.col("named"), E.any_of("labels", [V.MAIN_ROAD_LABEL]))
    per_vehicle = prepared.groupBy("zone_id", "time_bucket", "vehicle_number").agg(
        F.count("*").alias("n"), F.sum(label_severity()).alias("sev"), F.sum(exposed).alias("exposed"),
        F.sum(E.proxy_weight(E.trusted_vehicle(F.col("updated_vehicle_type"), F.col("vehicle_type")))).alias("w"),
        F.count_if(F.col("validation_status") == "approved").alias("ok"), F.count("validation_status").alias("known"))
    total = F.sum("n")
    zones = materialise(per_vehicle.groupBy("zone_id", "time_bucket").agg(
        total.alias("n"), F.sum("sev").alias("sev"), (F.sum("exposed") / total).alias("exposure"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / total).alias("repeats"),
        (F.sum("w") / total / max(V.PROXY_GROUPS)).alias("heavy"), ratio(F.sum("ok"), F.sum("known")).alias("confidence")), "proxy-zones")
    tops = zones.agg(F.max("n").alias("n"), F.max("sev").alias("sev"))
    top_n, top_sev = one_row(tops, "n", "sev")
    raw = (dbl(0.30) * F.col("n") / top_n + dbl(0.20) * F.col("sev") / top_sev + dbl(0.15) * F.col("exposure")
           + dbl(0.10) * F.col("repeats") + dbl(0.10) * F.col("heavy")
           + dbl(0.10) * lookup(F.col("time_bucket"), peak, 0.5) + dbl(0.05) * F.col("confidence"))
    rated = materialise(zones.withColumn("risk_raw", raw), "proxy-raw")
    low, high = one_row(rated.agg(F.min("risk_raw").alias("a"), F.max("risk_raw").alias("b")), "a", "b")
    scaled = ratio(F.col("risk_raw") - low, high - low) * dbl(100.0)
    label = F.when(F.col("risk_index") <= 30, "Low").when(F.col("risk_index") <= 60, "Medium").when(
        F.col("risk_index") <= 80, "High").otherwise("Critical")
    return rated.withColumn("risk_index", scaled).withColumn("band", label)


def zone_features(prepared: DataFrame) -> DataFrame:
    """Per zone: severity sum and max, days since the last event, devices, approval, rank within its station."""
    severity = label_severity()
    sums = [F.sum("n").alias("n"), F.sum("sev_sum").alias("sev_sum"), F.max("sev_max").alias("sev_max"), F.max("last").alias("last"),
            F.sum("ok").alias("ok"), F.sum("known").alias("known")]
    stored = materialise(prepared.groupBy("zone_id", "station", "device_id").agg(  # the only pass over the events
        F.count("*").alias("n"), F.sum(severity).alias("sev_sum"), F.max(severity).alias("sev_max"), F.max("local_ts").alias("last"),
        F.count_if(F.col("validation_status") == "approved").alias("ok"), F.count("validation_status").alias("known")), "zone-devices")
    per_device = stored.groupBy("zone_id", "device_id").agg(*sums)
    zones = per_device.groupBy("zone_id").agg(
        F.sum("n").alias("total_records"), F.sum("sev_sum").alias("severity_sum"), F.max("sev_max").alias("severity_max"),
        F.max("last").alias("last"), F.count("device_id").alias("device_count"),
        (F.max(F.when(F.col("device_id").isNotNull(), F.col("n"))) / F.sum("n")).alias("top_device_share"),
        ratio(F.sum("ok"), F.sum("known")).alias("approval_rate"), (F.sum("known") / F.sum("n")).alias("validation_coverage"))
    end = stored.agg(F.max("last")).scalar()
    dated = zones.withColumn("days_since_last", F.date_diff(F.to_date(end), F.to_date("last"))).drop("last")
    homes = stored.where(F.col("station").isNotNull()).groupBy("zone_id", "station").agg(F.sum("n").alias("n")).groupBy("zone_id").agg(
        F.min(F.struct((-F.col("n")).alias("minus"), "station")).getField("station").alias("station"))
    homed = dated.join(homes, "zone_id", "left").withColumn(
        "station", F.coalesce("station", F.lit("Unknown")))
    return position(homed, [("total_records", False), ("zone_id", True)], ["station"], "rank_in_station")
