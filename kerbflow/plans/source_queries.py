"""Scans and sinks exercised as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType as T_types

from kerbflow.operators import panel, scoring, serving, zones
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import d, define, rounded
from kerbflow.plans.panel_queries import stored_hourly
from kerbflow.plans.risk_queries import cleaned, risk_table
from kerbflow.session import shared_path
from kerbflow.sources import readers, sinks

_SUMMARY = "SELECT police_station, validation_status, count(*) AS n, avg(latitude) AS lat, count(junction_name) AS named FROM t_viol GROUP BY police_station, validation_status"


def summarised(df):
    return df.groupBy("police_station", "validation_status").agg(
        F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.count("junction_name").alias("named"))


def _raw(spark, folder):
    """The facts with all columns of the event schema, as a raw file has them; absent ones are null."""
    facts = T.facts(spark, folder)
    fields = T_types.fromDDL(readers.EVENT_SCHEMA).fields
    return facts.select(*[(F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@query("csv_scan", _SUMMARY, ["lat"])
def csv_scan(spark, folder):
    path = shared_path(spark, "csv")
    _raw(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return summarised(readers.read_events(path, spark, "csv"))


@query("json_scan", _SUMMARY, ["lat"])
def json_scan(spark, folder):
    path = shared_path(spark, "json")
    _raw(spark, folder).write.json(path)
    return summarised(readers.read_events(path, spark, "jsonl"))


def _write_documents(lines, path, opening, closing, size=2000):
    """Write (key, value) rows as one-document files of about ``size`` values."""
    documents = max(1, -(-lines.count() // size))
    body = lines.groupBy(F.pmod(F.xxhash64("key"), F.lit(documents)).alias("document")).agg(F.array_join(F.collect_list("value"), ",").alias("body"))
    body.select("document", F.concat(F.lit(opening), "body", F.lit(closing)).alias("value")).write.partitionBy("document").text(path)


@query("json_document_scan", _SUMMARY, ["lat"])
def json_document_scan(spark, folder):
    path = shared_path(spark, "json-document")
    _write_documents(_raw(spark, folder).select(F.col("id").alias("key"), F.to_json(F.struct("*")).alias("value")), path, "[", "]")
    return summarised(readers.read_events(path, spark, "json"))


@query("keyed_document_scan", "SELECT zone_id, travel_time_ratio FROM t_ratio", ["travel_time_ratio"])
def keyed_document_scan(spark, folder):
    path = shared_path(spark, "ratio-document")
    pairs = F.regexp_replace(F.to_json(F.create_map(F.col("zone_id"), F.struct(F.col("travel_time_ratio")))), r"^\{|\}$", "")
    _write_documents(T.ratios(spark, folder).select(F.col("zone_id").alias("key"), pairs.alias("value")), path, "{", "}")
    return readers.travel_ratios(spark, path, whole=True)


@query("parquet_scan", _SUMMARY, ["lat"])
def parquet_scan(spark, folder):
    path = shared_path(spark, "parquet")
    _raw(spark, folder).write.parquet(path)
    return summarised(readers.read_events(path, spark, "parquet"))


@query("keyed_map_scan", "SELECT zone_id, travel_time_ratio FROM t_ratio", ["travel_time_ratio"])
def keyed_map_scan(spark, folder):
    path = shared_path(spark, "ratios")
    placed = T.zone_places(spark, folder).select("zone_id")
    joined = placed.join(T.ratios(spark, folder), "zone_id", "left")  # zones without a ratio become null entries
    line = F.to_json(F.create_map(F.col("zone_id"), F.struct(F.col("travel_time_ratio"))))
    joined.select(line.alias("value")).write.text(path)
    return readers.travel_ratios(spark, path)


@query("artifact_round_trip", "SELECT zone_id, congestion_impact, impact_band, total_records FROM t_impact WHERE time_bucket = 'morning_peak'", ["congestion_impact"])
def artifact_round_trip(spark, folder):
    path = shared_path(spark, "artifact")
    sinks.write_artifact(scoring.nested(T.impact_table(spark, folder)), path)
    return readers.scores(spark, path, "morning_peak")


@query("artifact_counts", "SELECT count(*) AS entries, count(DISTINCT zone_id) AS zones, count(*) FILTER (is_defaulted = 0) AS measured_entries, count(DISTINCT zone_id) FILTER (is_defaulted = 0) AS measured_zones FROM t_impact")
def artifact_counts(spark, folder):
    per_zone = T.impact_table(spark, folder).groupBy("zone_id").agg(F.count("*").alias("e"), F.count_if(F.col("is_defaulted") == 0).alias("m"))
    return per_zone.agg(F.sum("e").alias("entries"), F.count("*").alias("zones"), F.sum("m").alias("measured_entries"),
                        F.count_if(F.col("m") > 0).alias("measured_zones"))


@query("hourly_export_files", "SELECT hour, count(*) AS n, max(risk_score) AS top FROM t_risk WHERE hour < 16 GROUP BY hour", ["top"])
def hourly_export_files(spark, folder):
    path = shared_path(spark, "hours")
    rows = risk_table(spark, folder).where("hour < 16").select("hour", "grid_cell_id", "risk_score", "risk_tier")
    sinks.write_hourly(rows, path)
    back = spark.read.schema("grid_cell_id STRING, risk_score DOUBLE, risk_tier INT, hour INT").json(path)
    return back.groupBy("hour").agg(F.count("*").alias("n"), F.max("risk_score").alias("top"))


@query("feature_csv", "SELECT grid_cell_id, count(*) AS n, sum(CAST(printf('%.5f', rolling_mean_24h) AS DOUBLE)) AS total FROM t_hourfeat GROUP BY grid_cell_id", {"total": 3})
def feature_csv(spark, folder):
    path = shared_path(spark, "features")
    rows = panel.hour_features(panel.hour_panel(stored_hourly(spark, folder))).select("grid_cell_id", "violation_count", "rolling_mean_24h")
    sinks.write_features(rows, path)
    back = spark.read.schema("grid_cell_id STRING, violation_count BIGINT, rolling_mean_24h DOUBLE").option("header", True).csv(path)
    return back.groupBy("grid_cell_id").agg(F.count("*").alias("n"), F.sum("rolling_mean_24h").alias("total"))


@query("replaced_table", "SELECT time_bucket, count(*) AS n, CAST(sum(total_records) AS BIGINT) AS total FROM t_zagg GROUP BY time_bucket")
def replaced_table(spark, folder):
    path = shared_path(spark, "replaced")
    sinks.replace_table(T.zone_table(spark, folder), path, ["time_bucket"])
    return spark.read.parquet(path).groupBy("time_bucket").agg(F.count("*").alias("n"), F.sum("total_records").alias("total"))


@query("frozen_snapshot", """
SELECT count(*) AS n, bit_xor(h) AS mixed, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total, 1 AS frozen FROM (
  SELECT ('0x' || substr(sha256(length(zone_id) || ':' || zone_id || length(time_bucket) || ':' || time_bucket || length(total_records::VARCHAR) || ':' || total_records || coalesce(length(station) || ':' || station, '-')), 1, 15))::BIGINT AS h FROM t_zagg)""")
def frozen_snapshot(spark, folder):
    columns = ["zone_id", "time_bucket", "total_records", "station"]
    path = shared_path(spark, "frozen")
    sinks.freeze(T.zone_table(spark, folder).select(*columns), path, columns, "zone table")
    checked = sinks.fingerprint(sinks.read_frozen(spark, path), columns)
    return checked.withColumn("frozen", sinks.provenance(spark, path).select("frozen").scalar())


define("t_ctx", f"""
SELECT vehicle_number AS zone_id, CAST(substr(vehicle_number, 2) AS BIGINT) AS source_order, min(latitude) AS lat, min(longitude) AS lon,
  {d(1.0)} + CAST(sum(signal) AS DOUBLE) / CAST(count(signal) AS DOUBLE) / {d(50.0)} AS travel_time_ratio FROM t_viol GROUP BY vehicle_number""")
_KEY7 = f"'z7_' || CAST(floor(lat / {d(0.02)}) AS BIGINT) || '_' || CAST(floor(lon / {d(0.02)}) AS BIGINT)"


def context(spark, folder):
    per = T.facts(spark, folder).groupBy(F.col("vehicle_number").alias("zone_id")).agg(
        F.min("latitude").alias("lat"), F.min("longitude").alias("lon"), F.sum("signal").alias("s"), F.count("signal").alias("c"))
    return per.selectExpr("zone_id", "CAST(substr(zone_id, 2) AS BIGINT) AS source_order", "lat", "lon",
                          "1D + CAST(s AS DOUBLE) / CAST(c AS DOUBLE) / 50D AS travel_time_ratio")


@query("rekey_last", f"SELECT zone_id, original_zone_id, lat, lon, travel_time_ratio FROM (SELECT {_KEY7} AS zone_id, zone_id AS original_zone_id, lat, lon, travel_time_ratio, row_number() OVER (PARTITION BY {_KEY7} ORDER BY source_order DESC) AS rn FROM t_ctx) WHERE rn = 1", ["lat", "lon", "travel_time_ratio"])
def rekey_last(spark, folder):
    return zones.rekey_last(context(spark, folder), 7)


@query("rekey_mean", f"SELECT {_KEY7} AS zone_id, avg(travel_time_ratio) AS travel_time_ratio FROM t_ctx GROUP BY 1", ["travel_time_ratio"])
def rekey_mean(spark, folder):
    return zones.rekey_mean(context(spark, folder), 7)
