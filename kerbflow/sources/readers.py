"""Scans: event files with a fixed schema, keyed maps, nested score documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.functions.basics import valid_ratio
from kerbflow.sources import documents

EVENT_SCHEMA = """
    id STRING, latitude DOUBLE, longitude DOUBLE, location STRING, vehicle_number STRING, vehicle_type STRING,
    description STRING, violation_type STRING, offence_code STRING, created_datetime STRING, closed_datetime STRING,
    modified_datetime STRING, device_id STRING, created_by_id STRING, center_code STRING, police_station STRING,
    data_sent_to_scita STRING, junction_name STRING, action_taken_timestamp STRING, data_sent_to_scita_timestamp STRING,
    updated_vehicle_number STRING, updated_vehicle_type STRING, validation_status STRING, validation_timestamp STRING"""


def read_events(source: str | DataFrame, spark: SparkSession | None = None, kind: str | None = None,
                schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events from CSV, Parquet, JSON or JSON lines; a DataFrame passes through.

    The kind comes from the suffix unless given. Schemas are fixed, so no file is read twice.
    """
    if isinstance(source, DataFrame):
        return source
    kind = kind or source.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(source)
    if kind in ("parquet", "pq"):
        return spark.read.schema(schema).parquet(source)
    if kind == "jsonl":
        return spark.read.schema(schema).json(source)
    if kind == "json":  # one document a file
        return documents.objects(spark, source).select(F.from_json("value", schema).alias("e")).select("e.*")
    raise ValueError(f"unsupported event source {source!r}: use csv, parquet, json or jsonl")


def keyed_map(spark: SparkSession, path: str, value: str, whole: bool = False) -> DataFrame:
    """Rows (key, value fields) of text files holding JSON objects keyed by zone id.

    Files have one object per line, or with ``whole`` one object per file; both are split over tasks.
    """
    text = documents.keyed(spark, path) if whole else spark.read.text(path)
    parsed = text.select(F.from_json("value", f"map<string, struct<{value}>>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "entry")).where(F.col("entry").isNotNull()).select("key", "entry.*")


def travel_ratios(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Valid ratios of a keyed map; entries without a usable number are left out."""
    rows = keyed_map(spark, path, "travel_time_ratio: double", whole)
    return rows.where(valid_ratio(F.col("travel_time_ratio"))).select(F.col("key").alias("zone_id"), "travel_time_ratio")


def scores(spark: SparkSession, path: str, bucket: str, whole: bool = False) -> DataFrame:
    """One bucket of nested documents {zone: {bucket: {...}}}."""
    text = documents.keyed(spark, path) if whole else spark.read.text(path)
    fields = "struct<congestion_impact: double, impact_band: string, total_records: bigint>"
    zones = text.select(F.explode(F.from_json("value", f"map<string, map<string, {fields}>>")).alias("zone_id", "buckets"))
    entry = F.try_element_at("buckets", F.lit(bucket))
    return zones.select("zone_id", entry.alias("e")).where(F.col("e").isNotNull()).select("zone_id", "e.*")
