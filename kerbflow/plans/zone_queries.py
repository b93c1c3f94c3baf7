"""Ingest, zone aggregates and impact scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import events as E
from kerbflow.functions import geo as G
from kerbflow.functions import labels as L
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import split_of
from kerbflow.operators import scoring, zones
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import band, case_hours, case_map, clamp, d, define, digest_mod

_AGG = """zone_id, time_bucket, total_records, main_road_count, double_park_count, junction_violation_count,
  access_violation_count, mean_vehicle_obstruction, has_named_junction, station, travel_time_ratio"""


@query("zone_bucket_aggregate", f"SELECT {_AGG}, array_to_string(top_violations, '|') AS top_violations FROM t_zagg",
       ["mean_vehicle_obstruction", "travel_time_ratio"])
def zone_bucket_aggregate(spark, folder):
    table = T.zone_table(spark, folder)
    return table.withColumn("top_violations", F.array_join("top_violations", "|")).drop("zi", "zj")


@query("corpus_maxima", "SELECT * FROM t_max", ["max_mean_obstruction"])
def corpus_maxima(spark, folder):
    return zones.maxima(T.zone_table(spark, folder))


_COMPONENTS = [*V.IMPACT_WEIGHTS, "severity"]


@query("impact_components", f"SELECT zone_id, time_bucket, {', '.join(_COMPONENTS)}, is_defaulted FROM t_comp", _COMPONENTS)
def impact_components(spark, folder):
    rated = scoring.components(T.stored_zone_table(spark, folder))
    return rated.select("zone_id", "time_bucket", *_COMPONENTS, "is_defaulted")


@query("impact_breakdown",
       "SELECT zone_id, time_bucket, congestion_impact, impact_band, lane_hours, lat, lon, total_records, station FROM t_impact",
       ["congestion_impact", "lane_hours", "lat", "lon"])
def impact_breakdown(spark, folder):
    return T.impact_table(spark, folder).select(
        "zone_id", "time_bucket", "congestion_impact", "impact_band", "lane_hours", "lat", "lon", "total_records", "station")


@query("hotspots_by_impact", """
SELECT zone_id, congestion_impact, impact_band, total_records AS violation_count, station, top_violations[1] AS top_violation, lane_hours,
  row_number() OVER (ORDER BY congestion_impact DESC, zone_id) AS place
FROM (SELECT * REPLACE (round(congestion_impact, 6) AS congestion_impact) FROM t_impact WHERE time_bucket = 'all_day')
ORDER BY congestion_impact DESC, zone_id LIMIT 50""", ["congestion_impact", "lane_hours"])
def hotspots_by_impact(spark, folder):
    from kerbflow.operators import serving

    return serving.hotspots(T.impact_table(spark, folder), limit=50)


_LEVELS = {level: V.ZONE_STEP * factor for level, factor in V.ZONE_FACTORS.items()}
define("t_levels", " UNION ALL ".join(
    f"SELECT {level} AS level, CAST(floor(CAST(zi AS DOUBLE) / {d(float(V.ZONE_FACTORS[level]))}) AS BIGINT) AS li, CAST(floor(CAST(zj AS DOUBLE) / {d(float(V.ZONE_FACTORS[level]))}) AS BIGINT) AS lj, time_bucket, weight, named, is_main, is_double, is_junction, is_access, police_station FROM t_both"
    for level in _LEVELS))
define("t_lagg", """
SELECT level, 'z' || level || '_' || li || '_' || lj AS zone_id, time_bucket, count(*) AS total_records, CAST(sum(is_main) AS BIGINT) AS main_road_count, CAST(sum(is_double) AS BIGINT) AS double_park_count,
  CAST(sum(is_junction) AS BIGINT) AS junction_violation_count, CAST(sum(is_access) AS BIGINT) AS access_violation_count, avg(weight) AS mean_vehicle_obstruction, max(named) AS has_named_junction FROM t_levels GROUP BY ALL""")


@query("multi_level_aggregate", "SELECT * FROM t_lagg", ["mean_vehicle_obstruction"])
def multi_level_aggregate(spark, folder):
    return zones.aggregate_levels(zones.prepare(T.facts(spark, folder))).drop("zi", "zj", "station", "top_violations")


@query("multi_level_components", f"""
SELECT a.level, a.zone_id, a.time_bucket, CAST(main_road_count + 2 * double_park_count AS DOUBLE) / greatest(m.lane, {d(1.0)}) AS lane_blockage,
  CAST(access_violation_count AS DOUBLE) / greatest(m.acc, {d(1.0)}) AS access_blockage, mean_vehicle_obstruction / m.obs AS vehicle_size
FROM t_lagg a JOIN (SELECT level, CAST(max(main_road_count + 2 * double_park_count) AS DOUBLE) AS lane, CAST(max(access_violation_count) AS DOUBLE) AS acc, max(mean_vehicle_obstruction) AS obs FROM t_lagg GROUP BY level) m ON m.level = a.level""",
       ["lane_blockage", "access_blockage", "vehicle_size"])
def multi_level_components(spark, folder):
    from kerbflow.session import materialise

    table = materialise(zones.aggregate_levels(zones.prepare(T.facts(spark, folder))), "levels")
    rated = scoring.components_by_level(zones.attach_ratio(table, None))
    return rated.select("level", "zone_id", "time_bucket", "lane_blockage", "access_blockage", "vehicle_size")


@query("zone_travel_ratios", "SELECT * FROM t_ratio", ["travel_time_ratio"])
def zone_travel_ratios(spark, folder):
    return T.ratios(spark, folder)


@query("zone_ratio_lookup", f"SELECT p.zone_id, r.travel_time_ratio, CASE WHEN r.travel_time_ratio > 0 THEN {clamp(f'(r.travel_time_ratio - {d(1.0)}) / {d(2.0)}')} ELSE {d(0.5)} END AS degradation FROM (SELECT DISTINCT zone_id FROM t_placed) p LEFT JOIN t_ratio r ON r.zone_id = p.zone_id", ["travel_time_ratio", "degradation"])
def zone_ratio_lookup(spark, folder):
    from kerbflow.functions.basics import dbl, degradation, valid_ratio

    seen = T.zone_places(spark, folder).select("zone_id")
    joined = zones.attach_ratio(seen, T.ratios(spark, folder))
    value = F.when(valid_ratio(F.col("travel_time_ratio")), degradation(F.col("travel_time_ratio"))).otherwise(dbl(0.5))
    return joined.withColumn("degradation", value)


@query("parsed_events", """
SELECT zone_id, time_bucket, count(*) AS n, CAST(sum(is_main) AS BIGINT) AS main, CAST(sum(is_double) AS BIGINT) AS double_park, CAST(sum(is_junction) AS BIGINT) AS junction, CAST(sum(is_access) AS BIGINT) AS access,
  CAST(sum(named) AS BIGINT) AS named, sum(weight) AS weight FROM t_prep GROUP BY zone_id, time_bucket""", ["weight"])
def parsed_events(spark, folder):
    rows = zones.prepare(T.facts(spark, folder))
    flags = {"main": [V.MAIN_ROAD_LABEL], "double_park": [V.DOUBLE_PARK_LABEL], "junction": V.JUNCTION_LABELS, "access": V.ACCESS_LABELS}
    return rows.groupBy("zone_id", "time_bucket").agg(
        F.count("*").alias("n"), *[F.sum(E.any_of("labels", words)).alias(name) for name, words in flags.items()],
        F.sum("named").alias("named"), F.sum("weight").alias("weight"))


@query("hour_bucket_fallback", f"SELECT DISTINCT hour(local_ts) AS hour, coalesce({case_hours('hour(local_ts)', V.IMPACT_BUCKETS)}, 'all_day') AS bucket FROM t_viol")
def hour_bucket_fallback(spark, folder):
    from kerbflow.operators.serving import hour_bucket

    hours = E.with_local_time(T.facts(spark, folder), "created_datetime").select(F.hour("local_ts").alias("hour")).distinct()
    return hours.withColumn("bucket", hour_bucket(F.col("hour")))


def _hex_sql(edge: float, base: float) -> str:
    import math

    x, y = f"longitude * {d(111.32 * math.cos(math.radians(base)))}", f"latitude * {d(110.574)}"
    return f"""SELECT *, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN -rr - rs ELSE rq END AS hq,
  CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s)) AND abs(rr - r) > abs(rs - s) THEN -rq - rs ELSE rr END AS hr
FROM (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(s + 0.5) AS rs FROM (SELECT *, -q - r AS s FROM (
  SELECT ({x} * {d(math.sqrt(3) / 3)} - {y} / {d(3.0)}) / {d(edge)} AS q, {y} * {d(2.0 / 3.0)} / {d(edge)} AS r FROM t_viol)))"""


@query("hexagon_zones", f"SELECT CAST(hq AS BIGINT) AS q, CAST(hr AS BIGINT) AS r, count(*) AS n FROM ({_hex_sql(0.2, 13.0)}) GROUP BY ALL")
def hexagon_zones(spark, folder):
    q, r = G.hex_axial(F.col("latitude"), F.col("longitude"), 0.2, 13.0)
    return T.facts(spark, folder).groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))
