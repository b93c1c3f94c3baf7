"""The stored feature table: dynamic overwrite by date, pruned split reads."""

import datetime

from pyspark.sql import functions as F

from kerbflow.operators import panel
from kerbflow.session import shared_path

DAY = datetime.date


def features(spark, days, lag):
    return spark.createDataFrame([(f"c{i}", DAY(2024, 1, d), d, lag, None if i else 0.5, "spare") for d in days for i in range(3)],
                                 "grid_cell_id string, date date, violation_count int, lag_1 double, mean_vehicle_severity double, spare string")


def test_split_reads_prune_and_overwrite_keeps_other_dates(spark):
    path = shared_path(spark, "split-test")
    first = features(spark, [1, 2, 3], 1.0)
    panel.store_features(first, path)
    panel.store_features(features(spark, [3, 4], None), path)  # replaces the third day, adds a fourth
    stored = spark.read.schema(first.schema).parquet(path)
    assert stored.groupBy("date").count().count() == 4
    rows = panel.load_split(stored, ["grid_cell_id", "date", "violation_count", "mean_vehicle_severity"], "2024-01-02", "2024-01-04")
    assert sorted((r.grid_cell_id, r.date.day, r.mean_vehicle_severity) for r in rows.collect()) == [("c0", 2, 0.5), ("c1", 2, 0.0), ("c2", 2, 0.0)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(date" in scan and "spare" not in scan.split("ReadSchema")[1]
    assert "lag_1" in scan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert rows.inputFiles() and panel.load_split(stored, ["date"]).where(F.col("date") > DAY(2025, 1, 1)).count() == 0
