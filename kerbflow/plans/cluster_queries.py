"""Density clusters per time bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.functions.events import hour_label
from kerbflow.operators import checks, cluster
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import case_hours, d, define
from kerbflow.plans.risk_queries import cleaned
from kerbflow.session import materialise

_SIDE = 0.003 / 2 ** 0.5 * 0.999
define("t_cev", f"SELECT {case_hours('hour', V.CLUSTER_BUCKETS)} AS time_bucket, latitude AS lat, longitude AS lon, junction_name FROM t_clean WHERE hour < 22")
define("t_cpt", f"""
SELECT *, time_bucket || '|' || CAST(floor(lat / {d(_SIDE)}) AS BIGINT) || '_' || CAST(floor(lon / {d(_SIDE)}) AS BIGINT) AS node
FROM (SELECT time_bucket, lat, lon, count(*) AS w FROM t_cev GROUP BY ALL)""")
define("t_cpair", f"""
SELECT a.time_bucket, a.lat, a.lon, a.node, b.lat AS blat, b.lon AS blon, b.node AS bnode, b.w AS bw FROM t_cpt a JOIN t_cpt b ON a.time_bucket = b.time_bucket AND abs(a.lat - b.lat) < 0.0031 AND abs(a.lon - b.lon) < 0.0033
WHERE pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) <= pow(sin(radians({d(0.003)}) / 2), 2)""")
define("t_ccore", "SELECT time_bucket, lat, lon, any_value(node) AS node, sum(bw) >= 10 AS core FROM t_cpair GROUP BY time_bucket, lat, lon")
define("t_clink", """
SELECT DISTINCT p.node AS src, p.bnode AS dst FROM t_cpair p JOIN t_ccore a ON a.time_bucket = p.time_bucket AND a.lat = p.lat AND a.lon = p.lon AND a.core
JOIN t_ccore b ON b.time_bucket = p.time_bucket AND b.lat = p.blat AND b.lon = p.blon AND b.core""")
define("t_cwalk", "SELECT src AS node, src AS seen FROM t_clink UNION SELECT w.node, l.dst FROM t_cwalk w JOIN t_clink l ON l.src = w.seen")
define("t_clabel", "SELECT node, min(seen) AS label FROM t_cwalk GROUP BY node")
define("t_cdone", """
SELECT c.time_bucket, c.lat, c.lon, p.w, CASE WHEN c.core THEN 1 ELSE 0 END AS core,
  CASE WHEN c.core THEN l.label ELSE (SELECT min(m.label) FROM t_cpair q JOIN t_ccore k ON k.time_bucket = q.time_bucket AND k.lat = q.blat AND k.lon = q.blon AND k.core JOIN t_clabel m ON m.node = k.node
    WHERE q.time_bucket = c.time_bucket AND q.lat = c.lat AND q.lon = c.lon) END AS label
FROM t_ccore c JOIN t_cpt p ON p.time_bucket = c.time_bucket AND p.lat = c.lat AND p.lon = c.lon LEFT JOIN t_clabel l ON l.node = c.node""")
define("t_share", f"""
SELECT time_bucket, n, n / {d(1.0)} / (SELECT count(*) FROM t_clean) AS share, CASE WHEN n / {d(1.0)} / (SELECT count(*) FROM t_clean) < 0.05 THEN 1 ELSE 0 END AS is_sparse,
  CASE WHEN n / {d(1.0)} / (SELECT count(*) FROM t_clean) >= 0.1 THEN 1 ELSE 0 END AS is_data_rich FROM (SELECT time_bucket, count(*) AS n FROM t_cev GROUP BY time_bucket)""")
_LAT, _LON = "radians(max(lat) - min(lat)) * CAST(6371.0 AS DOUBLE)", "radians(max(lon) - min(lon)) * CAST(6371.0 AS DOUBLE) * cos(radians((min(lat) + max(lat)) / 2))"
define("t_crec", f"""
SELECT s.*, j.top_junction, h.is_data_rich FROM (
  SELECT time_bucket, label, sum(lat * w) / sum(w) AS centroid_lat, sum(lon * w) / sum(w) AS centroid_lon, CAST(sum(w) AS BIGINT) AS member_count, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1,
    greatest({_LAT} * {_LON}, {d(1e-6)}) AS bbox_area_km2, sum(w) / greatest({_LAT} * {_LON}, {d(1e-6)}) AS cluster_density FROM t_cdone WHERE label IS NOT NULL GROUP BY time_bucket, label) s
LEFT JOIN (SELECT c.time_bucket, c.label, e.junction_name AS top_junction, row_number() OVER (PARTITION BY c.time_bucket, c.label ORDER BY count(*) DESC, e.junction_name) AS rn
  FROM t_cev e JOIN t_cdone c ON c.time_bucket = e.time_bucket AND c.lat = e.lat AND c.lon = e.lon WHERE c.label IS NOT NULL AND e.junction_name IS NOT NULL GROUP BY c.time_bucket, c.label, e.junction_name) j ON j.time_bucket = s.time_bucket AND j.label = s.label AND j.rn = 1
JOIN t_share h ON h.time_bucket = s.time_bucket""")


def bucketed(spark, folder):
    rows = cleaned(spark, folder).select("latitude", "longitude", "hour", "junction_name")
    return rows.withColumn("time_bucket", hour_label(F.col("hour"), V.CLUSTER_BUCKETS)).where(F.col("time_bucket").isNotNull())


@query("cluster_labels", "SELECT time_bucket, lat, lon, w, core, label FROM t_cdone", ["lat", "lon"])
def cluster_labels(spark, folder):
    return cluster.labelled(bucketed(spark, folder)).withColumn("core", F.col("core").cast("int"))


@query("bucket_shares", "SELECT * FROM t_share", ["share"])
def bucket_shares(spark, folder):
    return cluster.bucket_shares(cleaned(spark, folder))


def found(spark, folder):
    events = bucketed(spark, folder)
    points = materialise(cluster.labelled(events), "cluster-points")
    return cluster.records(events, points, cluster.bucket_shares(cleaned(spark, folder)))


_REC = "time_bucket, label, centroid_lat, centroid_lon, member_count, lat0, lat1, lon0, lon1, top_junction, bbox_area_km2, cluster_density, is_data_rich"


@query("cluster_records", f"SELECT {_REC} FROM t_crec", {**dict.fromkeys(["centroid_lat", "centroid_lon", "lat0", "lat1", "lon0", "lon1", "bbox_area_km2"], 6), "cluster_density": 3})
def cluster_records(spark, folder):
    return found(spark, folder).select(*_REC.split(", "))


@query("cluster_summary", "SELECT time_bucket, count(*) AS n_clusters, CAST(sum(member_count) AS BIGINT) AS total_members, avg(member_count) AS avg_members, max(member_count) AS max_members, max(is_data_rich) AS is_data_rich FROM t_crec GROUP BY time_bucket", ["avg_members"])
def cluster_summary(spark, folder):
    return cluster.summary(found(spark, folder))


@query("cluster_junction_check", "SELECT count(*) FILTER (top_junction IN (SELECT junction_name FROM t_clean)) AS known, count(*) FILTER (top_junction NOT IN (SELECT junction_name FROM t_clean WHERE junction_name IS NOT NULL)) AS unknown FROM t_crec")
def cluster_junction_check(spark, folder):
    return checks.unknown_values(found(spark, folder), "top_junction", cleaned(spark, folder), "junction_name")
