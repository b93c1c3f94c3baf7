"""Joins whose sides grow with the input are shuffled: a small file may unfold to more rows than the driver holds."""

import pytest
from pyspark.sql import functions as F

from kerbflow.operators import cluster


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_clusterer_broadcasts_no_points(spark):
    events = spark.range(600).select(
        F.lit("morning").alias("time_bucket"), (F.col("id") % 30 * 0.0011).alias("latitude"), (F.col("id") % 7 * 0.0013).alias("longitude"),
        F.lit("J").alias("junction_name"))
    points = cluster.gridded(events, "time_bucket", cluster.EPS_DEGREES)
    marked = cluster.core_points(points, "time_bucket", cluster.EPS_DEGREES, 10)
    assert "Broadcast" not in executed(marked)
    assert "Broadcast" not in executed(cluster.cell_edges(marked.where("core"), "time_bucket", cluster.EPS_DEGREES))
    labels = cluster.labelled(events)
    assert "Broadcast" not in executed(labels)
    assert labels.where("core").agg(F.countDistinct("label")).first()[0] >= 1


def test_top_k_broadcasts_no_vectors(spark):
    topk = pytest.importorskip("kerbflow.llm.topk")
    rows = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(0, 5), i -> CAST(sin(id * 7 + i) AS FLOAT)) AS embedding")
    seen, stored = [], topk.materialise

    def watched(df, label):
        seen.append(executed(df))
        return stored(df, label)

    topk.materialise = watched
    try:
        assert topk.search(rows, F.col("vec_id") % 50 == 0).count() == 40
    finally:
        topk.materialise = stored
    assert seen and not any("Broadcast" in plan for plan in seen)


def test_pairs_of_blocks_are_dealt_over_tasks(spark):
    mining = pytest.importorskip("kerbflow.llm.hard_negatives")
    known = spark.range(2).selectExpr("CAST(4 + id % 1 AS INT) AS dimension", "CAST(id AS INT) AS block", "array(id) AS ids", "array(0L) AS labels", "array(1D, 1D, 1D, 1D) AS columns")
    asked = spark.range(3 * mining.BLOCK_ANCHORS).selectExpr("CAST(4 + id % 1 AS INT) AS dimension", "id", "0L AS label", "array(1D, 1D, 1D, 1D) AS vector")
    met = mining._meet(asked, known, 2)
    assert met.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = met.select(F.col("ids")[0].alias("id"), F.size("asked").alias("n")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert [r.n for r in sizes] == 2 * [3 * mining.BLOCK_ANCHORS]
