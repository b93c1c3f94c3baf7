"""DuckDB twins: named table expressions and the composer that strings them together.

The SQL is written independently of the Spark plans (plain definitions, no shared shortcuts).
"""

from __future__ import annotations

import re

from kerbflow.functions import vocabulary as V

TABLES: dict[str, str] = {}


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def define(name: str, sql: str) -> None:
    TABLES[name] = sql


def case_map(column: str, table: dict[str, float], default: float) -> str:
    whens = " ".join(f"WHEN '{key}' THEN {d(value)}" for key, value in table.items())
    return f"(CASE {column} {whens} ELSE {d(default)} END)"


def case_hours(hour: str, buckets: list[tuple[int, int, str]]) -> str:
    whens = " ".join(f"WHEN {hour} >= {low} AND {hour} < {high} THEN '{name}'" for low, high, name in buckets)
    return f"(CASE {whens} END)"


def digest_mod(text: str, modulus: int) -> str:
    terms = [
        f"(('0x' || substr(sha256({text}), {1 + 8 * part}, 8))::BIGINT % {modulus}) * {pow(2 ** 32, 7 - part, modulus)}"
        for part in range(8)
    ]
    return f"(({' + '.join(terms)}) % {modulus})"


def hex_number(text: str, start: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, 8))::BIGINT"


def clamp(value: str) -> str:
    return f"greatest({d(0.0)}, least({d(1.0)}, {value}))"


def band(score: str) -> str:
    return (f"(CASE WHEN {score} <= 25 THEN 'MINIMAL' WHEN {score} <= 50 THEN 'MODERATE' "
            f"WHEN {score} <= 75 THEN 'SEVERE' ELSE 'CRITICAL' END)")


def rounded(value: str, digits: int, shift: float = 0.5) -> str:
    scale = f"CAST({10.0 ** digits!r} AS DOUBLE)"
    return f"floor(CAST({value} AS DOUBLE) * {scale} + CAST({shift!r} AS DOUBLE)) / {scale}"


def compose(final: str) -> str:
    """``final`` preceded by every named expression it needs, in dependency order."""
    needed: list[str] = []
    open_names: list[str] = []

    def visit(sql: str) -> None:
        for name in TABLES:
            if name not in needed and name not in open_names and re.search(rf"\b{name}\b", sql):
                open_names.append(name)  # a recursive table names itself
                visit(TABLES[name])
                open_names.remove(name)
                needed.append(name)

    visit(final)
    if not needed:
        return final
    blocks = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    return f"WITH RECURSIVE {blocks}\n{final}"


_E, _U = "event_id", "user_id"
define("t_viol", f"""
SELECT CAST(event_id AS VARCHAR) AS id,
  {d(12.8)} + CAST(user_id % 15 AS DOUBLE) * {d(0.0075)} + CAST(event_id % 7 AS DOUBLE) * {d(0.0004)} AS latitude,
  {d(77.44)} + (CAST(user_id - user_id % 15 AS DOUBLE) / {d(15.0)}) * {d(0.0105)} + CAST(event_id % 5 AS DOUBLE) * {d(0.0004)} AS longitude,
  'Stop ' || (user_id % 40) || ', Bengaluru. Pin-56' || (1000 + user_id % 60) || ' (India)' AS location,
  'V' || user_id AS vehicle_number,
  CASE event_id % 7 WHEN 0 THEN 'CAR' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'MOTOR CYCLE' WHEN 3 THEN 'BUS'
    WHEN 4 THEN 'LGV' WHEN 5 THEN 'MAXI-CAB' ELSE 'TRACTOR' END AS vehicle_type,
  CASE event_id % 11 WHEN 0 THEN 'CAR' WHEN 1 THEN 'NULL' END AS updated_vehicle_type,
  CASE event_type WHEN 'error' THEN '["DOUBLE PARKING"]' WHEN 'purchase' THEN '["PARKING IN A MAIN ROAD","WRONG PARKING"]'
    WHEN 'signup' THEN '["PARKING NEAR ROAD CROSSING"]' WHEN 'click' THEN '["WRONG PARKING","PARKING ON FOOTPATH"]'
    ELSE '["NO PARKING"]' END AS violation_type,
  ts AS created_datetime,
  ts + to_minutes(CAST((event_id * 37) % 2000 - 20 AS INTEGER)) AS modified_datetime,
  CASE WHEN event_id % 6 <> 5 THEN ts + to_minutes(CAST((event_id * 53) % 9000 - 5 AS INTEGER)) END AS validation_timestamp,
  'Station ' || (user_id % 12) AS police_station,
  CASE WHEN user_id % 12 <> 5 THEN 'C' || (user_id % 12) END AS center_code,
  'D' || (event_id % 23) AS device_id,
  CASE WHEN user_id % 3 = 0 THEN 'No Junction' WHEN user_id % 17 = 0 THEN NULL ELSE 'Junction ' || (user_id % 9) END AS junction_name,
  CASE event_id % 6 WHEN 0 THEN 'approved' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'created1'
    WHEN 4 THEN 'pending' END AS validation_status,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS signal,
  ts + INTERVAL 330 MINUTE AS local_ts
FROM events""")

define("t_placed", f"""
SELECT *, CAST(floor(latitude / {d(V.ZONE_STEP)}) AS BIGINT) AS zi, CAST(floor(longitude / {d(V.ZONE_STEP)}) AS BIGINT) AS zj,
  'z9_' || CAST(floor(latitude / {d(V.ZONE_STEP)}) AS BIGINT) || '_' || CAST(floor(longitude / {d(V.ZONE_STEP)}) AS BIGINT) AS zone_id
FROM t_viol""")

_vehicle = "upper(trim(CASE WHEN updated_vehicle_type IS NOT NULL AND updated_vehicle_type <> 'NULL' THEN updated_vehicle_type ELSE vehicle_type END))"
define("t_prep", f"""
SELECT * FROM (
  SELECT *, {case_hours('hour(local_ts)', V.IMPACT_BUCKETS)} AS time_bucket,
    {case_map(_vehicle, V.VEHICLE_OBSTRUCTION, V.DEFAULT_OBSTRUCTION)} AS weight,
    CASE WHEN junction_name IS NOT NULL AND upper(junction_name) <> 'NO JUNCTION' THEN 1 ELSE 0 END AS named,
    CASE WHEN violation_type LIKE '%"PARKING IN A MAIN ROAD"%' THEN 1 ELSE 0 END AS is_main,
    CASE WHEN violation_type LIKE '%"DOUBLE PARKING"%' THEN 1 ELSE 0 END AS is_double,
    CASE WHEN violation_type LIKE '%"PARKING NEAR ROAD CROSSING"%' THEN 1 ELSE 0 END AS is_junction,
    CASE WHEN violation_type LIKE '%"PARKING ON FOOTPATH"%' THEN 1 ELSE 0 END AS is_access
  FROM t_placed) WHERE time_bucket IS NOT NULL""")

define("t_both", """
SELECT zone_id, zi, zj, time_bucket, weight, named, is_main, is_double, is_junction, is_access, police_station, violation_type FROM t_prep
UNION ALL
SELECT zone_id, zi, zj, 'all_day', weight, named, is_main, is_double, is_junction, is_access, police_station, violation_type FROM t_prep""")

define("t_ratio", f"""
SELECT zone_id, {d(1.0)} + CAST(sum(signal) AS DOUBLE) / CAST(count(signal) AS DOUBLE) / {d(50.0)} AS travel_time_ratio
FROM t_placed GROUP BY zone_id
HAVING {digest_mod("'measure:' || zone_id", 100)} < 60""")

define("t_station", """
SELECT zone_id, time_bucket, police_station AS station FROM (
  SELECT zone_id, time_bucket, police_station, row_number() OVER (PARTITION BY zone_id, time_bucket ORDER BY count(*) DESC, police_station) AS rn
  FROM t_both GROUP BY zone_id, time_bucket, police_station) WHERE rn = 1""")

define("t_labels", """
SELECT zone_id, time_bucket, label, n, rn FROM (
  SELECT zone_id, time_bucket, label, count(*) AS n,
    row_number() OVER (PARTITION BY zone_id, time_bucket ORDER BY count(*) DESC, label) AS rn
  FROM (SELECT zone_id, time_bucket, unnest(string_split(regexp_replace(violation_type, '[\\[\\]"]', '', 'g'), ',')) AS label FROM t_both)
  GROUP BY zone_id, time_bucket, label) WHERE rn <= 5""")

define("t_zagg", """
SELECT b.zone_id, b.zi, b.zj, b.time_bucket, count(*) AS total_records, CAST(sum(is_main) AS BIGINT) AS main_road_count,
  CAST(sum(is_double) AS BIGINT) AS double_park_count, CAST(sum(is_junction) AS BIGINT) AS junction_violation_count,
  CAST(sum(is_access) AS BIGINT) AS access_violation_count, avg(weight) AS mean_vehicle_obstruction,
  max(named) AS has_named_junction, any_value(s.station) AS station, any_value(l.top_violations) AS top_violations,
  any_value(r.travel_time_ratio) AS travel_time_ratio
FROM t_both b
JOIN t_station s ON s.zone_id = b.zone_id AND s.time_bucket = b.time_bucket
JOIN (SELECT zone_id, time_bucket, list(label ORDER BY rn) AS top_violations FROM t_labels GROUP BY ALL) l
  ON l.zone_id = b.zone_id AND l.time_bucket = b.time_bucket
LEFT JOIN t_ratio r ON r.zone_id = b.zone_id
GROUP BY b.zone_id, b.zi, b.zj, b.time_bucket""")

define("t_max", """
SELECT CAST(max(main_road_count + 2 * double_park_count) AS DOUBLE) AS max_lane_load,
  CAST(max(junction_violation_count) AS DOUBLE) AS max_junction_load,
  CAST(max(access_violation_count) AS DOUBLE) AS max_access_count, max(mean_vehicle_obstruction) AS max_mean_obstruction
FROM t_zagg""")

_TD = f"CASE WHEN travel_time_ratio > 0 THEN {clamp(f'(travel_time_ratio - {d(1.0)}) / {d(2.0)}')} ELSE {d(0.5)} END"
define("t_comp", f"""
SELECT z.*,
  {clamp(f"CAST(main_road_count + 2 * double_park_count AS DOUBLE) / greatest(max_lane_load, {d(1.0)})")} AS lane_blockage,
  {clamp(f"CAST(junction_violation_count AS DOUBLE) / greatest(max_junction_load, {d(1.0)}) * (CASE WHEN has_named_junction = 1 THEN {d(1.5)} ELSE {d(0.5)} END)")} AS intersection_impact,
  {_TD} AS traffic_degradation,
  {clamp(f"CAST(access_violation_count AS DOUBLE) / greatest(max_access_count, {d(1.0)})")} AS access_blockage,
  {clamp(f"mean_vehicle_obstruction / greatest(max_mean_obstruction, {d(1e-9)})")} AS vehicle_size,
  {clamp(f"mean_vehicle_obstruction / {d(2.0)}")} AS severity,
  CASE WHEN travel_time_ratio > 0 THEN 0 ELSE 1 END AS is_defaulted,
  main_road_count * {d(0.5)} + double_park_count * {d(1.0)} + junction_violation_count * {d(0.75)}
    + greatest(total_records - main_road_count - double_park_count - junction_violation_count, 0) * {d(0.25)} AS lane_hours
FROM t_zagg z, t_max""")


def weighted(weights: dict[str, float]) -> str:
    return " + ".join(f"{d(value)} * {name}" for name, value in weights.items())


define("t_impact", f"""
SELECT *, (CAST(zi AS DOUBLE) + {d(0.5)}) * {d(V.ZONE_STEP)} AS lat, (CAST(zj AS DOUBLE) + {d(0.5)}) * {d(V.ZONE_STEP)} AS lon, {band(rounded('congestion_impact', 9))} AS impact_band FROM (
  SELECT *, greatest({d(0.0)}, least({d(100.0)}, {d(100.0)} * ({weighted(V.IMPACT_WEIGHTS)}))) AS congestion_impact FROM t_comp)""")
