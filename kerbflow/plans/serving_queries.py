"""Serving reads: universe, rankings, layers, stations, allocation, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.operators import calibrate, checks, scoring, serving
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import band, d, define, hex_number, rounded
from kerbflow.session import materialise
from kerbflow.sources import adapter

_LEGS = " UNION ALL ".join(
    f"SELECT zone_id, zone_id || ':{name}' AS k, '{name}' AS direction, {d(dlat)} AS dlat, {d(dlon)} AS dlon FROM t_ratio"
    for name, dlat, dlon in V.LEG_OFFSETS)
define("t_rawleg", f"""
SELECT zone_id, direction, dlat, dlon, baseline_s, baseline_s * ({d(1.0)} + CAST({hex_number('k', 9)} % 120 AS DOUBLE) / {d(100.0)}) AS eta_s,
  CASE WHEN {hex_number('k', 17)} % 3 <> 0 THEN CAST(200 + {hex_number('k', 17)} % 900 AS DOUBLE) END AS distance_m
FROM (SELECT *, CAST(60 + {hex_number('k', 1)} % 61 AS DOUBLE) AS baseline_s FROM ({_LEGS}))""")
define("t_context", f"""
SELECT zone_id, travel_time_ratio, 1 + {hex_number("'poi:' || zone_id", 1)} % 7 AS poi_count,
  CASE WHEN {hex_number("'poi:' || zone_id", 9)} % 4 = 0 THEN 1 ELSE 0 END AS is_exploration,
  'Road ' || ({hex_number("'poi:' || zone_id", 17)} % 50) || (CASE WHEN {hex_number("'poi:' || zone_id", 17)} % 5 = 0 THEN ' Main Road' ELSE ' Cross' END) AS road_name
FROM t_ratio""")
define("t_centre", f"""
SELECT DISTINCT zone_id, (CAST(zi AS DOUBLE) + {d(0.5)}) * {d(V.ZONE_STEP)} AS lat, (CAST(zj AS DOUBLE) + {d(0.5)}) * {d(V.ZONE_STEP)} AS lon FROM t_placed""")
define("t_leg", f"""
SELECT *, round(eta_s / baseline_s, 4) AS ratio, coalesce(distance_m, haversine_m) / baseline_s * {d(3.6)} AS speed_kmph,
  CASE WHEN distance_m IS NULL THEN 1 ELSE 0 END AS approx
FROM (SELECT l.*, {d(12742000.0)} * asin(sqrt(pow(sin(radians(dlat) / 2), 2) + cos(radians(lat)) * cos(radians(lat + dlat)) * pow(sin(radians(dlon) / 2), 2))) AS haversine_m
  FROM t_rawleg l JOIN t_centre c ON c.zone_id = l.zone_id)""")
define("t_obs", """
SELECT zone_id, median(ratio) AS congestion_ratio, count(ratio) AS n_legs, median(speed_kmph) AS free_flow_speed_kmph,
  max(approx) AS free_flow_speed_approx, median(baseline_s) AS free_flow_s FROM t_leg GROUP BY zone_id""")

define("t_calcols", f"""
SELECT zone_id, station, congestion_impact AS raw_score, travel_time_ratio, expected_ratio, travel_time_ratio - expected_ratio AS discrepancy, adjustment,
  greatest({d(0.0)}, least({d(100.0)}, congestion_impact * ({d(1.0)} + adjustment))) AS calibrated_score,
  CASE WHEN adjustment > 0.05 THEN 'adjusted_up' WHEN adjustment < -0.05 THEN 'adjusted_down' ELSE 'validated_accurate' END AS status
FROM (SELECT *, {d(0.3)} * ((travel_time_ratio - expected_ratio) / greatest(expected_ratio, {d(1.0)})) AS adjustment
  FROM (SELECT *, {d(1.0)} + congestion_impact / {d(100.0)} * {d(2.0)} AS expected_ratio FROM t_impact WHERE time_bucket = 'all_day'))""")
define("t_cal", f"SELECT *, {band('calibrated_score')} AS impact_band FROM t_calcols WHERE travel_time_ratio > 0")

define("t_day", "SELECT * FROM t_impact WHERE time_bucket = 'all_day'")
_NAME = "lower(road_name)"


def _universe(name: str, cut: str) -> None:
    define(f"{name}_top", f"SELECT z.*, row_number() OVER (ORDER BY total_records DESC, zone_id) AS place FROM t_day z {cut}")
    define(f"{name}_rated", f"""
SELECT *, greatest(CASE WHEN {_NAME} LIKE '%flyover%' THEN {d(0.95)} WHEN {_NAME} LIKE '%main road%' THEN {d(0.9)} WHEN {_NAME} LIKE '%circle%' THEN {d(0.85)}
    WHEN {_NAME} LIKE '%road%' THEN {d(0.75)} WHEN {_NAME} LIKE '%cross%' THEN {d(0.6)} ELSE {d(0.5)} END,
    coalesce(CASE WHEN travel_time_ratio <> 0 THEN least({d(1.0)}, {d(0.5)} + (travel_time_ratio - {d(1.0)})) END, {d(0.0)})) AS importance0,
  CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 67 THEN 'HIGH' WHEN risk_score >= 34 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label,
  pow(risk_score, {d(1.5)}) AS w
FROM (SELECT z.zone_id, z.lat, z.lon, z.station, z.congestion_impact, z.impact_band, z.place, c.travel_time_ratio, k.status AS agent_status, z.top_violations,
    z.total_records AS violation_count, z.lane_hours, z.vehicle_size, coalesce(c.road_name, z.station, z.zone_id) AS road_name,
    coalesce(k.calibrated_score, z.congestion_impact) AS calibrated_score,
    round({d(100.0)} * CAST(count(*) OVER () - z.place + 1 AS DOUBLE) / count(*) OVER (), 1) AS risk_score,
    CAST(z.total_records AS DOUBLE) / CAST(max(z.total_records) OVER () AS DOUBLE) AS density
  FROM {name}_top z LEFT JOIN t_context c ON c.zone_id = z.zone_id LEFT JOIN t_cal k ON k.zone_id = z.zone_id)""")
    define(name, f"""
SELECT *, round(importance0, 3) AS road_importance, CASE WHEN round(importance0, 3) > 0.8 THEN 'primary' ELSE 'secondary' END AS road_type,
  {d(0.3)} + {d(0.5)} * density AS repeat_offender, top_violations[1] AS top_violation, patrol_probability * {d(500.0)} AS expected_cost,
  ({d(1.0)} - patrol_probability) * risk_score - patrol_probability * {d(500.0)} AS net_benefit,
  greatest({d(0.0)}, least({d(100.0)}, ({d(1.0)} - patrol_probability) * risk_score - patrol_probability * {d(500.0)})) AS violator_risk_score
FROM (SELECT *, w / sum(w) OVER () AS patrol_probability, risk_score / sum(risk_score) OVER () AS baseline_weight FROM {name}_rated)""")


_universe("t_uni", "")
_universe("t_best60", "QUALIFY place <= 60")
define("t_peak", """
SELECT * FROM t_impact z WHERE time_bucket = 'morning_peak' OR (time_bucket = 'all_day'
  AND NOT EXISTS (SELECT 1 FROM t_zagg x WHERE x.zone_id = z.zone_id AND x.time_bucket = 'morning_peak'))""")


def scored(spark, folder):
    return materialise(T.impact_table(spark, folder), "impact")


def observations(spark, folder):
    return adapter.leg_records(T.ratios(spark, folder))


def served(spark, folder, table=None, size=None):
    table = scored(spark, folder) if table is None else table
    return materialise(
        serving.universe(table, observations(spark, folder), calibrate.calibrate_measured(table), size), "served")


_UNI = ("zone_id, lat, lon, station, congestion_impact, impact_band, travel_time_ratio, agent_status, violation_count, lane_hours, road_name, "
        "calibrated_score, risk_score, density, risk_label, road_importance, repeat_offender, top_violation, road_type, patrol_probability, "
        "baseline_weight, expected_cost, net_benefit, violator_risk_score")
_UNI_FLOATS = {**dict.fromkeys(["lat", "lon", "congestion_impact", "travel_time_ratio", "lane_hours", "calibrated_score", "risk_score", "density",
                               "road_importance", "repeat_offender", "baseline_weight", "expected_cost", "net_benefit", "violator_risk_score"], 6),
               "patrol_probability": 8}


@query("zone_universe", f"SELECT {_UNI} FROM t_best60", _UNI_FLOATS)
def zone_universe(spark, folder):
    table = scored(spark, folder)
    return serving.universe(table, observations(spark, folder), calibrate.calibrate_measured(table), serving.UNIVERSE).select(*_UNI.split(", "))


@query("all_zones", f"SELECT {_UNI} FROM t_uni", _UNI_FLOATS)
def all_zones(spark, folder):
    return served(spark, folder).select(*_UNI.split(", "))


@query("bucket_fallback", "SELECT zone_id, time_bucket, congestion_impact, impact_band FROM t_peak", ["congestion_impact"])
def bucket_fallback(spark, folder):
    return serving.at_bucket(T.impact_table(spark, folder), "morning_peak").select(
        "zone_id", "time_bucket", "congestion_impact", "impact_band")


@query("top_zones_all_day", "SELECT zone_id, risk_score, row_number() OVER (ORDER BY risk_score DESC, zone_id) AS place FROM t_uni QUALIFY place <= 15", ["risk_score"])
def top_zones_all_day(spark, folder):
    table = scored(spark, folder)
    return serving.top_zones(served(spark, folder, table), table, 15).select("zone_id", "risk_score", "place")


_RESCORED = """
SELECT u.zone_id, u.station, u.risk_score, u.lat, u.lon, round(coalesce(p.congestion_impact, u.congestion_impact), 6) AS congestion_impact, coalesce(p.impact_band, u.impact_band) AS impact_band
FROM t_uni u LEFT JOIN t_peak p ON p.zone_id = u.zone_id"""


@query("top_zones_by_bucket", f"SELECT zone_id, congestion_impact, impact_band, row_number() OVER (ORDER BY congestion_impact DESC, zone_id) AS place FROM ({_RESCORED}) QUALIFY place <= 15", ["congestion_impact"])
def top_zones_by_bucket(spark, folder):
    table = scored(spark, folder)
    return serving.top_zones(served(spark, folder, table), table, 15, "morning_peak").select(
        "zone_id", "congestion_impact", "impact_band", "place")


@query("station_zones_by_bucket", f"SELECT zone_id, congestion_impact, impact_band FROM ({_RESCORED}) WHERE lower(station) = 'station 3'", ["congestion_impact"])
def station_zones_by_bucket(spark, folder):
    table = scored(spark, folder)
    rows = serving.station_zones(served(spark, folder, table), "STATION 3")
    return serving.rescored(rows, table, "morning_peak").select("zone_id", "congestion_impact", "impact_band")


@query("station_priority_areas", f"""
SELECT zone_id, risk_score, pos AS place, CASE WHEN risk_score >= 67 THEN 3 WHEN risk_score >= 34 THEN 2 ELSE 1 END AS force_needed,
  CASE WHEN risk_score >= 67 THEN 'High' WHEN risk_score >= 34 THEN 'Medium' ELSE 'Low' END AS priority, distance_km,
  greatest(3, CAST(round_even(distance_km * 4, 0) AS INTEGER)) AS eta_minutes
FROM (SELECT *, round(sqrt(pow(abs(lat - base_lat) * {d(111.0)}, 2) + pow(abs(lon - base_lon) * {d(111.0)} * {d(0.87)}, 2)), 1) AS distance_km,
    row_number() OVER (ORDER BY risk_score DESC, zone_id) AS pos
  FROM (SELECT *, avg(lat) OVER () AS base_lat, avg(lon) OVER () AS base_lon FROM t_uni WHERE lower(station) = 'station 3'))
WHERE pos <= 10""", ["risk_score", "distance_km"])
def station_priority_areas(spark, folder):
    rows = serving.station_zones(served(spark, folder), "Station 3")
    return serving.priority_areas(rows).select("zone_id", "risk_score", "place", "force_needed", "priority", "distance_km", "eta_minutes")


@query("stations", "SELECT station, count(*) AS zone_count, CAST(sum(violation_count) AS BIGINT) AS total_violations, avg(lat) AS lat, avg(lon) AS lon FROM t_uni GROUP BY station", ["lat", "lon"])
def stations(spark, folder):
    return serving.stations(served(spark, folder))


@query("station_summary", """
SELECT station, count(*) AS total_zones, CAST(sum(violation_count) AS BIGINT) AS total_violations, count(*) FILTER (risk_score >= 67) AS high_risk_zones,
  count(*) FILTER (risk_score >= 34 AND risk_score < 67) AS medium_zones, count(*) FILTER (risk_score < 34) AS low_zones,
  CAST(sum(CASE WHEN risk_score >= 67 THEN 3 WHEN risk_score >= 34 THEN 2 ELSE 1 END) AS BIGINT) AS total_force FROM t_uni GROUP BY station""")
def station_summary(spark, folder):
    return serving.station_summary(served(spark, folder))


@query("station_label_breakdown", "SELECT station, risk_label, count(*) AS zone_count, avg(risk_score) AS avg_score, min(risk_score) AS min_score, max(risk_score) AS max_score, CAST(sum(violation_count) AS BIGINT) AS total_violations FROM t_uni GROUP BY station, risk_label", ["avg_score", "min_score", "max_score"])
def station_label_breakdown(spark, folder):
    return serving.label_breakdown(served(spark, folder), "station")


@query("label_summary", "SELECT risk_label, count(*) AS zone_count, avg(risk_score) AS avg_score, min(risk_score) AS min_score, max(risk_score) AS max_score, CAST(sum(violation_count) AS BIGINT) AS total_violations FROM t_uni GROUP BY risk_label", ["avg_score", "min_score", "max_score"])
def label_summary(spark, folder):
    return serving.label_breakdown(served(spark, folder))


@query("risk_overview", """
SELECT risk_label, count(*) AS zone_count, avg(risk_score) AS avg_score, CAST(sum(violation_count) AS BIGINT) AS total_violations,
  (SELECT zone_id FROM t_uni ORDER BY risk_score DESC, zone_id LIMIT 1) AS top_zone, (SELECT count(*) FROM t_uni) AS total_zones FROM t_uni GROUP BY risk_label""", ["avg_score"])
def risk_overview(spark, folder):
    return serving.overview(served(spark, folder))


@query("risk_filter", "SELECT zone_id, risk_score, risk_label FROM t_uni WHERE risk_label = 'HIGH'", ["risk_score"])
def risk_filter(spark, folder):
    return served(spark, folder).where(F.col("risk_label") == "HIGH").select("zone_id", "risk_score", "risk_label")


@query("impact_layer", "SELECT zone_id, lat, lon, impact_band, congestion_impact AS intensity FROM t_peak", ["lat", "lon", "intensity"])
def impact_layer(spark, folder):
    return serving.impact_layer(T.impact_table(spark, folder), "morning_peak")


@query("density_layer", "SELECT zone_id, lat, lon, impact_band, CAST(total_records AS DOUBLE) AS intensity FROM t_peak", ["lat", "lon", "intensity"])
def density_layer(spark, folder):
    return serving.density_layer(T.impact_table(spark, folder), "morning_peak")


@query("calibrated_layer", "SELECT zone_id, lat, lon, calibrated_score AS intensity FROM t_uni", ["lat", "lon", "intensity"])
def calibrated_layer(spark, folder):
    return serving.served_layer(served(spark, folder), "calibrated_score")


@query("violator_layer", "SELECT zone_id, lat, lon, violator_risk_score AS intensity FROM t_uni", ["lat", "lon", "intensity"])
def violator_layer(spark, folder):
    return serving.served_layer(served(spark, folder), "violator_risk_score")


@query("layer_intensity_range", "SELECT count(*) AS points, min(congestion_impact) AS min_intensity, max(congestion_impact) AS max_intensity FROM t_peak", ["min_intensity", "max_intensity"])
def layer_intensity_range(spark, folder):
    return serving.intensity_range(serving.impact_layer(T.impact_table(spark, folder), "morning_peak"))


@query("patrol_overlay", "SELECT zone_id, lat, lon, patrol_probability, risk_score FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, zone_id) AS rn FROM t_uni) WHERE rn <= 50 AND patrol_probability > 0.001", ["lat", "lon", "patrol_probability", "risk_score"])
def patrol_overlay(spark, folder):
    return serving.patrol_overlay(served(spark, folder))


@query("impact_patrol_probability", f"SELECT zone_id, congestion_impact, pow(congestion_impact, {d(1.5)}) / sum(pow(congestion_impact, {d(1.5)})) OVER () AS patrol_probability FROM t_day", {"congestion_impact": 6, "patrol_probability": 9})
def impact_patrol_probability(spark, folder):
    return serving.impact_probabilities(T.impact_table(spark, folder), V.ALL_DAY)


@query("patrol_leaders", "SELECT zone_id, round(patrol_probability, 9) AS patrol_probability, row_number() OVER (ORDER BY round(patrol_probability, 9) DESC, zone_id) AS place FROM t_uni QUALIFY place <= 100", {"patrol_probability": 9})
def patrol_leaders(spark, folder):
    return serving.leaders(served(spark, folder), "patrol_probability", 100)


@query("violator_leaders", "SELECT zone_id, round(violator_risk_score, 9) AS violator_risk_score, row_number() OVER (ORDER BY round(violator_risk_score, 9) DESC, zone_id) AS place FROM t_uni QUALIFY place <= 100", ["violator_risk_score"])
def violator_leaders(spark, folder):
    return serving.leaders(served(spark, folder), "violator_risk_score", 100)


define("t_assign", "SELECT *, row_number() OVER (ORDER BY risk_score DESC, zone_id) AS rn FROM t_uni")


@query("team_allocation_report", f"""
SELECT count(*) FILTER (rn <= 5) AS num_teams, sum(CASE WHEN rn <= 5 THEN risk_score ELSE 0 END) AS total_risk_covered,
  sum(CASE WHEN rn <= 5 THEN risk_score ELSE 0 END) / sum(risk_score) * {d(100.0)} AS coverage_pct,
  count(*) FILTER (rn > 5 AND risk_score >= 67) AS uncovered_high_risk FROM t_assign""", ["total_risk_covered", "coverage_pct"])
def team_allocation_report(spark, folder):
    return serving.allocation_report(served(spark, folder), 5)


@query("team_assignments", "SELECT rn AS team, zone_id, station, risk_score, patrol_probability FROM t_assign WHERE rn <= 5", {"risk_score": 6, "patrol_probability": 8})
def team_assignments(spark, folder):
    return serving.assignments(served(spark, folder), 5)


@query("uncovered_high_risk", "SELECT zone_id, risk_score FROM t_assign WHERE rn > 5 AND risk_score >= 67", ["risk_score"])
def uncovered_high_risk(spark, folder):
    return serving.uncovered_high(served(spark, folder), 5)


@query("coverage_curve", f"""
SELECT n AS num_teams, (SELECT sum(risk_score) FROM t_assign WHERE rn <= n) / (SELECT sum(risk_score) FROM t_assign) * {d(100.0)} AS coverage_pct,
  (SELECT count(*) FROM t_assign WHERE rn > n AND risk_score >= 67) AS uncovered_high_risk
FROM (SELECT rn AS n FROM t_assign WHERE rn <= 10)""", ["coverage_pct"])
def coverage_curve(spark, folder):
    return serving.coverage_curve(served(spark, folder))


_D2 = "(a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)"


@query("nearest_uncovered_displacement", f"""
SELECT u.zone_id, u.risk_score AS original_risk, u.risk_score * ({d(1.0)} + least(push, {d(0.25)})) AS adjusted_risk, least(push, {d(0.25)}) * {d(100.0)} AS risk_change_pct
FROM t_uni u JOIN (SELECT dst, sum({d(0.12)} * p) AS push FROM (
  SELECT a.zone_id AS src, b.zone_id AS dst, a.patrol_probability AS p, row_number() OVER (PARTITION BY a.zone_id ORDER BY {_D2}, b.zone_id) AS near
  FROM t_assign a, t_assign b WHERE a.rn <= 5 AND b.rn > 5) WHERE near = 1 GROUP BY dst) s ON s.dst = u.zone_id""", ["original_risk", "adjusted_risk", "risk_change_pct"])
def nearest_uncovered_displacement(spark, folder):
    return serving.displaced_zones(served(spark, folder))


@query("zone_arrows", f"""
SELECT src AS from_zone, dst AS to_zone, p AS weight FROM (
  SELECT a.zone_id AS src, b.zone_id AS dst, a.patrol_probability AS p, row_number() OVER (PARTITION BY a.zone_id ORDER BY {_D2}, b.zone_id) AS near
  FROM t_assign a, t_assign b WHERE a.rn <= 5 AND a.zone_id <> b.zone_id) WHERE near = 1""", ["weight"])
def zone_arrows(spark, folder):
    return serving.zone_arrows(served(spark, folder))


@query("explore_allocation", f"""
SELECT zone_id, risk_score, violation_count, {d(0.9)} * (pow(risk_score, {d(1.5)}) / sum(pow(risk_score, {d(1.5)})) OVER ())
  + {d(0.1)} * (({d(1.0)} / ({d(1.0)} + violation_count)) / sum({d(1.0)} / ({d(1.0)} + violation_count)) OVER ()) AS allocation FROM t_uni""", {"risk_score": 6, "allocation": 9})
def explore_allocation(spark, folder):
    return serving.explore_allocation(served(spark, folder))


@query("game_summary", "SELECT count(*) AS zones, max(patrol_probability) AS max_patrol_prob, avg(patrol_probability) AS avg_patrol_prob, avg(violator_risk_score) AS avg_violator_risk, max(violator_risk_score) AS max_violator_risk, avg(expected_cost) AS avg_expected_cost FROM t_uni",
       ["max_patrol_prob", "avg_patrol_prob", "avg_violator_risk", "max_violator_risk", "avg_expected_cost"])
def game_summary(spark, folder):
    return serving.game_summary(served(spark, folder))


@query("volume_forecast", f"SELECT zone_id, violation_count / {d(151.0)} AS predicted_count, violation_count / {d(151.0)} * {d(0.8)} AS confidence_lower, violation_count / {d(151.0)} * {d(1.25)} AS confidence_upper FROM t_uni",
       ["predicted_count", "confidence_lower", "confidence_upper"])
def volume_forecast(spark, folder):
    return serving.volume_forecast(served(spark, folder))


define("t_curve", f"""
SELECT *, pow(impact, {d(1.5)}) / sum(pow(impact, {d(1.5)})) OVER () AS p FROM (
  SELECT zone_id, round(congestion_impact, 6) AS impact, row_number() OVER (ORDER BY round(congestion_impact, 6) DESC, zone_id) AS rn FROM t_day)""")


@query("congestion_index_curve", f"""
SELECT n AS num_teams, index_before, index_after, (index_before - index_after) / index_before * {d(100.0)} AS pct_reduction, (index_before - index_after) * {d(45.0)} AS minutes_saved
FROM (SELECT n, sum(impact / {d(100.0)}) AS index_before, sum(impact * ({d(1.0)} - {d(0.6)} * ({d(1.0)} - pow({d(1.0)} - p, n))) / {d(100.0)}) AS index_after
  FROM t_curve, (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS n) GROUP BY n)""", ["index_before", "index_after", "pct_reduction", "minutes_saved"])
def congestion_index_curve(spark, folder):
    return serving.index_curve(T.impact_table(spark, folder))


@query("top_impact_values", "SELECT zone_id, impact, rn AS place FROM t_curve WHERE rn <= 60", ["impact"])
def top_impact_values(spark, folder):
    rows = serving.at_bucket(T.impact_table(spark, folder), V.ALL_DAY).select("zone_id", F.round("congestion_impact", 6).alias("impact"))
    return serving.best(rows, 60, F.col("impact").desc(), F.col("zone_id"))


@query("hotspots_by_bucket", """
SELECT zone_id, congestion_impact, impact_band, total_records AS violation_count, station, top_violations[1] AS top_violation, lane_hours,
  row_number() OVER (ORDER BY congestion_impact DESC, zone_id) AS place
FROM (SELECT * REPLACE (round(congestion_impact, 6) AS congestion_impact) FROM t_peak) QUALIFY place <= 50""", ["congestion_impact", "lane_hours"])
def hotspots_by_bucket(spark, folder):
    return serving.hotspots(T.impact_table(spark, folder), "morning_peak", 50)


# Text twins are built from rounded numbers with the same rules, so whole strings compare.
def _fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rounded(value, digits)})"


_STORY = f"""'Zone ' || zone_id || ' on ' || coalesce(road_name, 'this corridor') || ' (' || coalesce(station, 'Unknown') || ' PS) scores ' || {_fixed('congestion_impact', 0)}
  || '/100, band ' || impact_band || ', at 09:00. Violations: ' || violation_count || ', mostly ' || coalesce(top_violation, 'N/A')
  || '; lane-hours blocked per day: ' || {_fixed('lane_hours', 2)} || '. '
  || coalesce('Measured travel time is ' || {_fixed('travel_time_ratio', 2)} || 'x free flow', 'No travel-time measurement')
  || coalesce('; calibrated score ' || {_fixed('calibrated_score', 0)} || '/100', '') || '.'"""


@query("zone_stories", f"SELECT zone_id, {_STORY} AS explanation FROM t_uni")
def zone_stories(spark, folder):
    return serving.stories(served(spark, folder))


define("t_resolved", """
SELECT z.zone_id, CASE WHEN u.zone_id IS NOT NULL THEN 1 ELSE 0 END AS is_served, z.station, z.congestion_impact, z.impact_band,
  z.total_records AS violation_count, z.top_violations[1] AS top_violation, z.lane_hours,
  CASE WHEN u.zone_id IS NOT NULL THEN u.travel_time_ratio ELSE z.travel_time_ratio END AS travel_time_ratio, u.calibrated_score, u.road_name
FROM t_day z LEFT JOIN t_best60 u ON u.zone_id = z.zone_id""")


@query("resolved_zone_stories", f"SELECT zone_id, {_STORY} AS explanation FROM t_resolved")
def resolved_zone_stories(spark, folder):
    table = scored(spark, folder)
    ids = table.select("zone_id").distinct()
    return serving.stories(serving.resolved(ids, served(spark, folder, table, serving.UNIVERSE), table))


@query("short_zone_stories", f"""
SELECT zone_id, 'Zone ' || zone_id || ' (' || station || ' PS) scores ' || {_fixed('congestion_impact', 1)} || '/100, band ' || impact_band || '. Mainly '
  || array_to_string(top_violations[1:2], ', ') || '; ' || {_fixed('lane_hours', 1)} || ' lane-hours blocked per day.'
  || CASE WHEN travel_time_ratio > 1.2 THEN ' Travel time is ' || {_fixed('travel_time_ratio', 1)} || 'x free flow.' ELSE '' END || ' '
  || CASE impact_band WHEN 'CRITICAL' THEN 'Enforce now, during the morning peak.' WHEN 'SEVERE' THEN 'Put first in the next patrol cycle.'
    WHEN 'MODERATE' THEN 'Plan routine patrol coverage.' ELSE 'Monitor; review if counts rise.' END AS explanation FROM t_day""")
def short_zone_stories(spark, folder):
    from kerbflow.functions import labels as L

    day = T.impact_table(spark, folder).where(F.col("time_bucket") == V.ALL_DAY)
    text = L.short_story(F.col("zone_id"), F.col("station"), F.col("congestion_impact"), F.col("impact_band"),
                         F.col("top_violations"), F.col("lane_hours"), F.col("travel_time_ratio"))
    return day.select("zone_id", text.alias("explanation"))


_CAL = "zone_id, station, raw_score, travel_time_ratio, expected_ratio, discrepancy, adjustment, calibrated_score, status, impact_band"
_CAL_FLOATS = ["raw_score", "travel_time_ratio", "expected_ratio", "discrepancy", "adjustment", "calibrated_score"]


@query("calibrate_measured", f"SELECT {_CAL} FROM t_cal", _CAL_FLOATS)
def calibrate_measured(spark, folder):
    return calibrate.calibrate_measured(T.impact_table(spark, folder)).select(*_CAL.split(", "))


@query("calibrate_report_only", f"""
SELECT zone_id, station, raw_score, travel_time_ratio, expected_ratio, discrepancy, {d(0.0)} AS adjustment, raw_score AS calibrated_score, 'report_only' AS status, {band('raw_score')} AS impact_band FROM t_cal""", _CAL_FLOATS)
def calibrate_report_only(spark, folder):
    return calibrate.calibrate_measured(T.impact_table(spark, folder), nudge=False).select(*_CAL.split(", "))


define("t_calall", f"""
SELECT zone_id, raw_score, travel_time_ratio, CASE WHEN travel_time_ratio <> 0 THEN expected_ratio END AS expected_ratio,
  CASE WHEN travel_time_ratio <> 0 THEN discrepancy END AS discrepancy, CASE WHEN travel_time_ratio <> 0 THEN adjustment ELSE {d(0.0)} END AS adjustment,
  CASE WHEN travel_time_ratio <> 0 THEN calibrated_score ELSE raw_score END AS calibrated_score,
  CASE WHEN travel_time_ratio <> 0 THEN status ELSE 'no_data' END AS status FROM t_calcols""")


def _calibrated_all(spark, folder):
    day = T.impact_table(spark, folder).where(F.col("time_bucket") == V.ALL_DAY)
    return calibrate.calibrate_all(day.select("zone_id", F.col("congestion_impact").alias("raw_score"), "travel_time_ratio"))


@query("calibrate_all", f"SELECT *, {band('calibrated_score')} AS impact_band FROM t_calall", _CAL_FLOATS)
def calibrate_all(spark, folder):
    return _calibrated_all(spark, folder)


@query("calibration_summary", """
SELECT count(*) AS total_zones, count(*) FILTER (status <> 'no_data') AS validated, count(*) FILTER (status = 'no_data') AS no_data,
  count(*) FILTER (status = 'validated_accurate') AS accurate, count(*) FILTER (status = 'adjusted_up') AS adjusted_up, count(*) FILTER (status = 'adjusted_down') AS adjusted_down,
  avg(CASE WHEN status <> 'no_data' THEN abs(adjustment) END) * 100 AS mean_abs_adjustment_pct, max(CASE WHEN status <> 'no_data' THEN abs(adjustment) END) * 100 AS max_abs_adjustment_pct FROM t_calall""",
       ["mean_abs_adjustment_pct", "max_abs_adjustment_pct"])
def calibration_summary(spark, folder):
    return calibrate.calibration_summary(_calibrated_all(spark, folder))


@query("calibration_log", f"""
SELECT zone_id, status, CASE status WHEN 'adjusted_up' THEN 'Raised ' || moved || gap WHEN 'adjusted_down' THEN 'Lowered ' || moved || gap
  WHEN 'validated_accurate' THEN 'Kept ' || {_fixed('raw_score', 0)} || gap ELSE 'No measurement near ' || zone_id || '; kept ' || {_fixed('raw_score', 0)} END AS reasoning
FROM (SELECT *, {_fixed('raw_score', 0)} || ' to ' || {_fixed('calibrated_score', 0)} AS moved,
  ' near ' || zone_id || ': measured ' || {_fixed('travel_time_ratio', 2)} || 'x, expected ' || {_fixed('expected_ratio', 2)} || 'x' AS gap FROM t_calall)""")
def calibration_log(spark, folder):
    return calibrate.calibration_log(_calibrated_all(spark, folder))


@query("calibrated_zone_detail", """
SELECT z.zone_id, z.congestion_impact, z.impact_band, k.calibrated_score AS calibrated_impact, CASE WHEN z.time_bucket = 'morning_peak' THEN 'calibrated' ELSE 'uncalibrated' END AS time_regime
FROM t_peak z LEFT JOIN t_cal k ON k.zone_id = z.zone_id""", ["congestion_impact", "calibrated_impact"])
def calibrated_zone_detail(spark, folder):
    table = scored(spark, folder)
    extra = calibrate.calibrate_measured(table).select("zone_id", F.col("calibrated_score").alias("calibrated_impact"))
    rows = serving.at_bucket(table, "morning_peak").join(extra, "zone_id", "left")
    regime = F.when(F.col("time_bucket") == "morning_peak", "calibrated").otherwise("uncalibrated")
    return rows.select("zone_id", "congestion_impact", "impact_band", "calibrated_impact", regime.alias("time_regime"))


@query("leg_measurements", "SELECT zone_id, direction, baseline_s, eta_s, haversine_m, ratio, speed_kmph, approx FROM t_leg",
       {"baseline_s": 3, "eta_s": 3, "haversine_m": 4, "ratio": 4, "speed_kmph": 5})
def leg_measurements(spark, folder):
    return calibrate.leg_table(observations(spark, folder), centres(spark, folder))


def centres(spark, folder):
    return scoring.with_centre(T.zone_places(spark, folder))


def observed(spark, folder):
    return calibrate.observe(calibrate.leg_table(observations(spark, folder), centres(spark, folder)))


@query("zone_observations", "SELECT * FROM t_obs", {"congestion_ratio": 4, "free_flow_speed_kmph": 5, "free_flow_s": 3})
def zone_observations(spark, folder):
    return observed(spark, folder)


@query("road_classes", """
SELECT zone_id, CASE WHEN free_flow_speed_kmph > 40 THEN 'arterial' WHEN free_flow_speed_kmph >= 20 THEN 'collector' WHEN free_flow_speed_kmph > 0 THEN 'local' ELSE 'unknown' END AS road_class,
  CASE WHEN free_flow_speed_kmph > 40 THEN 3 WHEN free_flow_speed_kmph >= 20 THEN 2 WHEN free_flow_speed_kmph > 0 THEN 1 ELSE 0 END AS road_rank FROM t_obs""")
def road_classes(spark, folder):
    from kerbflow.functions import labels as L

    speed = F.col("free_flow_speed_kmph")
    return observed(spark, folder).select("zone_id", L.road_class(speed).alias("road_class"), L.road_rank(speed).alias("road_rank"))


define("t_core", "SELECT zone_id, total_records, row_number() OVER (ORDER BY total_records DESC, zone_id) AS rn FROM t_day")
define("t_select", """
SELECT zone_id, 0 AS is_exploration FROM t_core WHERE rn <= 110 UNION ALL
SELECT zone_id, 1 FROM (SELECT zone_id, row_number() OVER (ORDER BY sha256('7:' || zone_id), zone_id) AS pick FROM t_core WHERE rn > 110) WHERE pick <= 40""")


@query("collection_selection", "SELECT * FROM t_select")
def collection_selection(spark, folder):
    return serving.selection(scored(spark, folder)).select("zone_id", "is_exploration")


@query("collection_remaining", "SELECT count(*) AS zones_to_do, count(*) * 10 AS calls, CASE WHEN count(*) * 10 <= 1000 THEN 1 ELSE 0 END AS fits_budget FROM t_select WHERE zone_id NOT IN (SELECT zone_id FROM t_ratio)")
def collection_remaining(spark, folder):
    table = scored(spark, folder)
    return serving.calls_needed(serving.selection(table), T.ratios(spark, folder), 1000)


@query("breakdown_contract", """
SELECT unnest(['components_in_unit_range', 'score_in_range', 'counts_not_negative', 'weights_sum_to_one', 'label_known']) AS rule,
  unnest([(SELECT count(*) FROM t_impact WHERE NOT (lane_blockage BETWEEN 0 AND 1 AND intersection_impact BETWEEN 0 AND 1 AND traffic_degradation BETWEEN 0 AND 1 AND access_blockage BETWEEN 0 AND 1 AND vehicle_size BETWEEN 0 AND 1 AND severity BETWEEN 0 AND 1)),
  (SELECT count(*) FROM t_impact WHERE congestion_impact NOT BETWEEN 0 AND 100), (SELECT count(*) FROM t_impact WHERE total_records < 0 OR lane_hours < 0), 0,
  (SELECT count(*) FROM t_impact WHERE impact_band NOT IN ('MINIMAL', 'MODERATE', 'SEVERE', 'CRITICAL'))]) AS broken""")
def breakdown_contract(spark, folder):
    return checks.contract(scoring.nested(T.impact_table(spark, folder)))


@query("heavy_share_proxy", """
SELECT zone_id, CASE WHEN contains(top_violation, 'MAIN ROAD') OR contains(top_violation, 'DOUBLE') THEN CAST(0.22 AS DOUBLE) WHEN contains(top_violation, 'BUS') THEN CAST(0.18 AS DOUBLE)
  WHEN contains(top_violation, 'ROAD CROSSING') OR contains(top_violation, 'TRAFFIC LIGHT') THEN CAST(0.12 AS DOUBLE) ELSE CAST(0.08 AS DOUBLE) END AS heavy_share FROM t_uni""", ["heavy_share"])
def heavy_share_proxy(spark, folder):
    from kerbflow.functions import labels as L

    return served(spark, folder).select("zone_id", L.heavy_share_from_label(F.col("top_violation")).alias("heavy_share"))
