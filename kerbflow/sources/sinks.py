"""Sinks: replaced tables, JSON documents, hourly exports, rounded CSV, frozen snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "n bigint, mixed bigint, total string, data string, columns string, source string"


def replace_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, partitioned so that later reads prune."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def artifact_lines(nested: DataFrame) -> DataFrame:
    """One JSON line per zone with its buckets in order; at most five buckets per zone."""
    body = [c for c in nested.columns if c not in ("zone_id", "time_bucket")]
    entries = F.collect_list(F.struct("time_bucket", F.struct(*body).alias("entry")))
    by_name = F.array_sort(entries, lambda a, b: F.when(a["time_bucket"] < b["time_bucket"], -1).otherwise(1))
    per_zone = nested.groupBy("zone_id").agg(F.map_from_entries(by_name).alias("buckets"))
    return per_zone.select("zone_id", F.to_json(F.create_map(F.col("zone_id"), F.col("buckets"))).alias("value"))


def write_artifact(nested: DataFrame, path: str) -> None:
    """Zones in id order, so that equal input gives equal files."""
    artifact_lines(nested).orderBy("zone_id").select("value").write.mode("overwrite").text(path)


def write_hourly(rows: DataFrame, path: str) -> None:
    """JSON lines per hour."""
    rows.write.mode("overwrite").partitionBy("hour").json(path)


def five_decimals(df: DataFrame) -> DataFrame:
    """Doubles as text with five decimals; other columns unchanged."""
    columns = {
        field.name: F.when(F.col(field.name).isNotNull(), F.format_string("%.5f", F.col(field.name)))
        for field in df.schema if isinstance(field.dataType, T.DoubleType)}
    return df.withColumns(columns)


def write_features(df: DataFrame, path: str) -> None:
    five_decimals(df).write.mode("overwrite").option("header", True).csv(path)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content hash of a table from one aggregate over row hashes.

    Each value enters with its length, nulls as a bare dash, so different rows have different texts.
    """
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    text = F.concat(*parts)
    row = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return df.select(row.alias("h")).agg(
        F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("total"))


def _manifest(spark: SparkSession, path: str) -> Row | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def freeze(df: DataFrame, path: str, columns: Sequence[str], source: str = "") -> DataFrame:
    """Write a snapshot once; the manifest names its data, its fingerprint and where it comes from.

    The data goes to a folder of its own and the manifest comes last, so a reader sees a whole snapshot or none. A
    second write to the path fails and leaves the first alone.
    """
    spark = df.sparkSession
    if _manifest(spark, path) is not None:
        raise FileExistsError(f"{path} is frozen")
    data = f"data-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(f"{path}/{data}")
    made = fingerprint(spark.read.parquet(f"{path}/{data}"), columns).select("*", F.lit(data).alias("data"), F.lit(",".join(columns)).alias("columns"), F.lit(source).alias("source"))
    made.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return provenance(spark, path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(n, mixed, total, source, frozen) of a snapshot; without one a row of nulls with ``frozen`` 0."""
    found = _manifest(spark, path)
    kept = [found[c] for c in ("n", "mixed", "total", "source")] if found else [None] * 4
    return spark.createDataFrame([(*kept, int(found is not None))], "n bigint, mixed bigint, total string, source string, frozen int")


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot, after its content was found to be what the manifest says."""
    found = _manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no frozen snapshot at {path}")
    rows = spark.read.parquet(f"{path}/{found.data}")
    now = fingerprint(rows, found.columns.split(",")).first()
    if (now.n, now.mixed, now.total) != (found.n, found.mixed, found.total):
        raise ValueError(f"snapshot {path} has changed since it was frozen")
    return rows
