"""Lattice path: cleaned events, composite risk, patrol quantities, displacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import geo as G
from kerbflow.functions import labels as L
from kerbflow.functions import vocabulary as V
from kerbflow.operators import displacement, neighbours, risk, zones
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import case_hours, case_map, d, define, weighted
from kerbflow.session import materialise

_VEHICLE = "upper(trim(CASE WHEN updated_vehicle_type IS NOT NULL AND updated_vehicle_type <> 'NULL' THEN updated_vehicle_type ELSE vehicle_type END))"
_PEAK = "IN (8, 9, 10, 17, 18, 19)"
define("t_clean", f"""
SELECT *, cell_i || '_' || cell_j AS grid_cell_id,
  CAST(cell_i AS DOUBLE) * {d(0.005)} + {d(0.0025)} AS grid_lat, CAST(cell_j AS DOUBLE) * {d(0.005)} + {d(0.0025)} AS grid_lon
FROM (SELECT id, latitude, longitude, hour(local_ts) AS hour, isodow(local_ts) - 1 AS day_of_week, month(local_ts) AS month,
    CAST(local_ts AS DATE) AS date, CASE WHEN isodow(local_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour(local_ts) {_PEAK} THEN 1 ELSE 0 END AS is_peak,
    {case_hours('hour(local_ts)', V.LEGACY_BUCKETS)} AS time_bucket,
    regexp_extract(location, 'Pin-([0-9]+)', 1) AS pincode,
    CAST(floor(latitude / {d(0.005)}) AS BIGINT) AS cell_i, CAST(floor(longitude / {d(0.005)}) AS BIGINT) AS cell_j,
    {_VEHICLE} AS vehicle_type_final, {case_map(_VEHICLE, V.VEHICLE_SEVERITY, V.DEFAULT_SEVERITY)} AS vehicle_severity,
    validation_status AS validation_status_clean, {case_map('validation_status', V.STATUS_TRUST, V.DEFAULT_TRUST)} AS validation_trust,
    string_split(regexp_replace(violation_type, '[\\[\\]"]', '', 'g'), ',')[1] AS primary_violation,
    junction_name, police_station
  FROM t_viol)""")

define("t_cellhour", """
SELECT a.*, b.repeat_offender FROM (
  SELECT grid_cell_id, cell_i, cell_j, hour, min(grid_lat) AS grid_lat, min(grid_lon) AS grid_lon, count(*) AS violation_count,
    avg(validation_trust) AS validation_trust, avg(vehicle_severity) AS heavy_vehicle_ratio,
    max(CASE WHEN junction_name IS NOT NULL AND junction_name <> 'No Junction' THEN 1 ELSE 0 END) AS has_junction
  FROM t_clean GROUP BY grid_cell_id, cell_i, cell_j, hour) a
JOIN (
  SELECT grid_cell_id, hour, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS repeat_offender
  FROM (SELECT grid_cell_id, hour, date, count(*) AS n FROM t_clean GROUP BY grid_cell_id, hour, date) GROUP BY grid_cell_id, hour) b
ON a.grid_cell_id = b.grid_cell_id AND a.hour = b.hour""")

define("t_risk", f"""
SELECT *, CASE WHEN risk_score <= 33 THEN 'LOW' WHEN risk_score <= 60 THEN 'MEDIUM' WHEN risk_score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_tier_label,
  CASE WHEN risk_score <= 33 THEN 0 WHEN risk_score <= 60 THEN 1 WHEN risk_score <= 80 THEN 2 ELSE 3 END AS risk_tier
FROM (SELECT *, greatest({d(0.0)}, least({d(100.0)}, ({weighted(V.RISK_WEIGHTS)}) * {d(100.0)})) AS risk_score
  FROM (SELECT *, CAST(violation_count AS DOUBLE) / CAST(max(violation_count) OVER (PARTITION BY hour) AS DOUBLE) AS density,
      CASE WHEN has_junction = 1 THEN {d(0.8)} ELSE {d(0.4)} END AS road_importance,
      CASE WHEN hour {_PEAK} THEN {d(1.5)} ELSE {d(1.0)} END AS peak_weight,
      CASE WHEN hour {_PEAK} THEN {d(1.0)} ELSE {d(0.0)} END AS peak_norm
    FROM t_cellhour))""")

define("t_history", """
SELECT grid_cell_id, hour, CAST(least(3, greatest(0, round_even(CAST(n AS DOUBLE) / CAST(max(n) OVER () AS DOUBLE) * 3, 0))) AS INTEGER) AS patrol_count
FROM (SELECT grid_cell_id, hour, count(*) AS n FROM t_clean WHERE validation_status_clean = 'approved' GROUP BY grid_cell_id, hour)""")

define("t_patrol", f"""
SELECT *, adjusted_weight / (sum(adjusted_weight) OVER (PARTITION BY hour) + {d(1e-12)}) AS patrol_probability
FROM (SELECT r.*, coalesce(h.patrol_count, 0) AS patrol_count, pow(risk_score, {d(1.5)}) AS baseline_weight,
    pow(risk_score, {d(1.5)}) / ({d(1.0)} + {d(0.3)} * coalesce(h.patrol_count, 0)) AS adjusted_weight
  FROM t_risk r LEFT JOIN t_history h ON r.grid_cell_id = h.grid_cell_id AND r.hour = h.hour)""")

# Ranks compare probabilities at 9 decimals on both sides, so that the last bits of a sum cannot swap ties.
define("t_ranked", """
SELECT *, row_number() OVER (PARTITION BY hour ORDER BY p9 DESC, grid_cell_id) AS blotto_priority
FROM (SELECT *, round(patrol_probability, 9) AS p9 FROM t_patrol)""")

define("t_whatif", f"""
SELECT s.hour, s.k, s.n_zones, s.n_high_critical, coalesce(c.n, 0) AS n_covered_high_critical,
  CASE WHEN s.n_high_critical > 0 THEN CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(s.n_high_critical AS DOUBLE) * {d(100.0)} ELSE {d(0.0)} END AS coverage_pct
FROM (SELECT hour, k, n_zones, n_high_critical FROM (SELECT hour, count(*) AS n_zones,
    CAST(sum(CASE WHEN risk_score >= 60 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_critical FROM t_ranked GROUP BY hour),
    (SELECT unnest([2, 4, 6, 8, 10, 15, 20]) AS k)) s
LEFT JOIN (SELECT hour, k, count(*) AS n FROM t_ranked, (SELECT unnest([2, 4, 6, 8, 10, 15, 20]) AS k)
  WHERE blotto_priority <= k AND risk_score >= 60 GROUP BY hour, k) c ON s.hour = c.hour AND s.k = c.k""")

define("t_utility", f"""
SELECT *, CASE WHEN violator_risk_score <= 40 THEN 'search_legal' WHEN violator_risk_score <= 60 THEN 'uncertain' ELSE 'park_illegally' END AS adaptation_response
FROM (SELECT *, {d(100.0)} / ({d(1.0)} + exp(-net_benefit / {d(100.0)})) AS violator_risk_score
  FROM (SELECT *, time_saved - search_time AS benefit, (time_saved - search_time) * {d(20.0)} - expected_cost AS net_benefit
    FROM (SELECT *, least(road_importance * peak_weight * {d(15.0)}, {d(22.5)}) AS time_saved,
        {d(5.0)} + ({d(1.0)} - road_importance) * {d(10.0)} AS search_time, patrol_probability * {d(500.0)} AS expected_cost FROM t_patrol)))""")

define("t_cells", "SELECT DISTINCT grid_cell_id, cell_i, cell_j FROM t_clean")
define("t_knn", """
SELECT src, dst, dist, place FROM (
  SELECT a.grid_cell_id AS src, b.grid_cell_id AS dst,
    CAST((a.cell_i - b.cell_i) * (a.cell_i - b.cell_i) + (a.cell_j - b.cell_j) * (a.cell_j - b.cell_j) AS DOUBLE) AS dist,
    row_number() OVER (PARTITION BY a.grid_cell_id ORDER BY (a.cell_i - b.cell_i) * (a.cell_i - b.cell_i) + (a.cell_j - b.cell_j) * (a.cell_j - b.cell_j), b.grid_cell_id) AS place
  FROM t_cells a, t_cells b WHERE a.grid_cell_id <> b.grid_cell_id) WHERE place <= 6""")

define("t_hot", """
SELECT hour, grid_cell_id FROM (SELECT *, count(*) OVER (PARTITION BY hour) AS n FROM t_ranked)
WHERE blotto_priority <= greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT))""")
define("t_hop1", """
SELECT DISTINCT h.hour, k.dst AS grid_cell_id FROM t_hot h JOIN t_knn k ON k.src = h.grid_cell_id
WHERE NOT EXISTS (SELECT 1 FROM t_hot x WHERE x.hour = h.hour AND x.grid_cell_id = k.dst)""")
define("t_hop2", """
SELECT DISTINCT f.hour, k.dst AS grid_cell_id FROM t_hop1 f JOIN t_knn k ON k.src = f.grid_cell_id
WHERE NOT EXISTS (SELECT 1 FROM t_hot x WHERE x.hour = f.hour AND x.grid_cell_id = k.dst)
  AND NOT EXISTS (SELECT 1 FROM t_hop1 x WHERE x.hour = f.hour AND x.grid_cell_id = k.dst)""")
define("t_open", "SELECT hour, grid_cell_id FROM t_utility WHERE adaptation_response IN ('park_illegally', 'uncertain')")
define("t_set1", """
SELECT s.* FROM t_hop1 s LEFT JOIN t_open o ON o.hour = s.hour AND o.grid_cell_id = s.grid_cell_id
WHERE o.hour IS NOT NULL OR s.hour NOT IN (SELECT z.hour FROM t_hop1 z JOIN t_open q ON q.hour = z.hour AND q.grid_cell_id = z.grid_cell_id)""")
define("t_set2", """
SELECT s.* FROM t_hop2 s LEFT JOIN t_open o ON o.hour = s.hour AND o.grid_cell_id = s.grid_cell_id
WHERE o.hour IS NOT NULL OR s.hour NOT IN (SELECT z.hour FROM t_hop2 z JOIN t_open q ON q.hour = z.hour AND q.grid_cell_id = z.grid_cell_id)""")
define("t_adds", f"""
SELECT t.hour, CASE WHEN n1 = 0 THEN {d(0.0)} WHEN n2 > 0 THEN total * {d(0.7)} / n1 ELSE total / n1 END AS add1,
  CASE WHEN n2 = 0 THEN {d(0.0)} WHEN n1 > 0 THEN total * {d(0.3)} / n2 ELSE total / n2 END AS add2, CASE WHEN n1 = 0 AND n2 = 0 THEN total ELSE {d(0.0)} END AS lost_risk
FROM (SELECT r.hour, sum(r.risk_score * ({d(1.0)} - {d(0.8)})) AS total FROM t_risk r JOIN t_hot h ON h.hour = r.hour AND h.grid_cell_id = r.grid_cell_id GROUP BY r.hour) t
JOIN (SELECT h.hour, (SELECT count(*) FROM t_set1 s WHERE s.hour = h.hour) AS n1, (SELECT count(*) FROM t_set2 s WHERE s.hour = h.hour) AS n2
  FROM (SELECT DISTINCT hour FROM t_hot) h) c ON c.hour = t.hour""")
define("t_spill", f"""
SELECT *, CASE WHEN original_risk > 0 THEN (adjusted_risk - original_risk) / original_risk * {d(100.0)} ELSE {d(0.0)} END AS risk_change_pct,
  abs(adjusted_risk - original_risk) AS magnitude
FROM (SELECT grid_cell_id, hour, cell_i, cell_j, grid_lat, grid_lon, risk_score AS original_risk, spillover_type, lost_risk,
  greatest({d(0.0)}, least({d(100.0)}, CASE spillover_type WHEN 'patrolled' THEN risk_score * {d(0.8)} WHEN 'neighbor_1' THEN risk_score + add1
    WHEN 'neighbor_2' THEN risk_score + add2 ELSE risk_score END)) AS adjusted_risk
  FROM (SELECT r.*, a.add1, a.add2, a.lost_risk, CASE WHEN h.hour IS NOT NULL THEN 'patrolled' WHEN s1.hour IS NOT NULL THEN 'neighbor_1'
      WHEN s2.hour IS NOT NULL THEN 'neighbor_2' ELSE 'unaffected' END AS spillover_type
    FROM t_risk r LEFT JOIN t_hot h ON h.hour = r.hour AND h.grid_cell_id = r.grid_cell_id
    LEFT JOIN t_set1 s1 ON s1.hour = r.hour AND s1.grid_cell_id = r.grid_cell_id
    LEFT JOIN t_set2 s2 ON s2.hour = r.hour AND s2.grid_cell_id = r.grid_cell_id
    LEFT JOIN t_adds a ON a.hour = r.hour))""")
define("t_arrow", """
SELECT s.hour, s.grid_cell_id AS to_cell, round(s.magnitude, 6) AS magnitude, p.from_cell FROM t_spill s
JOIN (SELECT hour, to_cell, from_cell FROM (
  SELECT h.hour, k.dst AS to_cell, h.grid_cell_id AS from_cell, row_number() OVER (PARTITION BY h.hour, k.dst ORDER BY k.dist, h.grid_cell_id) AS rn
  FROM t_hot h JOIN t_knn k ON k.src = h.grid_cell_id) WHERE rn = 1) p ON p.hour = s.hour AND p.to_cell = s.grid_cell_id
WHERE s.spillover_type = 'neighbor_1' AND s.magnitude > 0.1""")


def cleaned(spark, folder):
    return zones.clean_legacy(T.facts(spark, folder))


def hour_table(spark, folder):
    return T.once(spark, folder, "cell-hours", lambda: risk.cell_hours(cleaned(spark, folder)))


def risk_table(spark, folder):
    return risk.scores(hour_table(spark, folder))


def patrol_table(spark, folder):
    hours = hour_table(spark, folder)
    return risk.patrol_probability(materialise(risk.scores(hours), "risk"), risk.patrol_history(hours))


def stored_patrol(spark, folder):
    return materialise(patrol_table(spark, folder), "patrol")


def ranked_input(spark, folder):
    stored = stored_patrol(spark, folder)
    return stored.withColumn("patrol_probability", F.round("patrol_probability", 9))


_CLEAN = ("hour, day_of_week, month, CAST(date AS VARCHAR) AS date, is_weekend, is_peak, time_bucket, pincode, grid_cell_id, grid_lat, grid_lon, "
          "vehicle_type_final, vehicle_severity, validation_status_clean, validation_trust, primary_violation, latitude, longitude")


@query("clean_events", f"SELECT {_CLEAN} FROM t_clean", ["grid_lat", "grid_lon", "latitude", "longitude"])
def clean_events(spark, folder):
    return cleaned(spark, folder).selectExpr(*[
        part.strip().replace("VARCHAR", "STRING") for part in _CLEAN.split(", ")])


@query("cell_hour_aggregate",
       "SELECT grid_cell_id, hour, grid_lat, grid_lon, violation_count, validation_trust, heavy_vehicle_ratio, has_junction FROM t_cellhour",
       ["grid_lat", "grid_lon", "validation_trust", "heavy_vehicle_ratio"])
def cell_hour_aggregate(spark, folder):
    return risk.cell_hours(cleaned(spark, folder)).drop("cell_i", "cell_j", "repeat_offender", "approved_count")


@query("repeat_ratio", "SELECT grid_cell_id, hour, repeat_offender FROM t_cellhour", ["repeat_offender"])
def repeat_ratio(spark, folder):
    return risk.cell_hours(cleaned(spark, folder)).select("grid_cell_id", "hour", "repeat_offender")


@query("hourly_density", "SELECT grid_cell_id, hour, violation_count, density FROM t_risk", ["density"])
def hourly_density(spark, folder):
    return risk_table(spark, folder).select("grid_cell_id", "hour", "violation_count", "density")


_RISK = "grid_cell_id, hour, risk_score, risk_tier_label, risk_tier, violation_count, density, road_importance, peak_weight, repeat_offender, validation_trust, heavy_vehicle_ratio"


@query("composite_risk", f"SELECT {_RISK} FROM t_risk",
       ["risk_score", "density", "repeat_offender", "validation_trust", "heavy_vehicle_ratio"])
def composite_risk(spark, folder):
    return risk_table(spark, folder).select(*_RISK.split(", "))


@query("risk_tier_distribution", "SELECT risk_tier_label, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM t_risk) AS DOUBLE) * 100 AS pct FROM t_risk GROUP BY risk_tier_label", ["pct"])
def risk_tier_distribution(spark, folder):
    return risk.distribution(risk_table(spark, folder), "risk_tier_label")


@query("hourly_risk_export", "SELECT hour, grid_cell_id AS cell, grid_lat AS lat, grid_lon AS lon, risk_score AS risk, risk_tier AS tier FROM t_risk WHERE hour < 16",
       ["lat", "lon", "risk"])
def hourly_risk_export(spark, folder):
    return risk_table(spark, folder).where(F.col("hour") < V.RICH_HOURS).select(
        "hour", F.col("grid_cell_id").alias("cell"), F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"),
        F.col("risk_score").alias("risk"), F.col("risk_tier").alias("tier"))


@query("patrol_history", "SELECT * FROM t_history")
def patrol_history(spark, folder):
    return risk.patrol_history(hour_table(spark, folder))


_PATROL = "grid_cell_id, hour, risk_score, baseline_weight, adjusted_weight, patrol_probability"


@query("patrol_probability", f"SELECT {_PATROL} FROM t_patrol",
       {"risk_score": 6, "baseline_weight": 6, "adjusted_weight": 6, "patrol_probability": 9})
def patrol_probability(spark, folder):
    return patrol_table(spark, folder).select(*_PATROL.split(", "))


@query("hourly_allocation", "SELECT grid_cell_id, hour, blotto_priority, CASE WHEN blotto_priority <= 6 THEN 1 ELSE 0 END AS teams_assigned FROM t_ranked")
def hourly_allocation(spark, folder):
    return risk.allocation(ranked_input(spark, folder)).select("grid_cell_id", "hour", "blotto_priority", "teams_assigned")


@query("coverage_by_teams", "SELECT * FROM t_whatif", ["coverage_pct"])
def coverage_by_teams(spark, folder):
    return risk.coverage_by_teams(ranked_input(spark, folder))


@query("coverage_report", """
SELECT k, avg(coverage_pct) AS avg_coverage_pct, string_agg(hour || ':' || CAST(round(coverage_pct * 100) AS BIGINT), ',' ORDER BY hour) AS by_hour
FROM t_whatif GROUP BY k""", ["avg_coverage_pct"])
def coverage_report(spark, folder):
    report = risk.coverage_report(risk.coverage_by_teams(ranked_input(spark, folder)))
    return report.withColumn("by_hour", F.expr(
        "array_join(transform(array_sort(map_entries(by_hour)), e -> concat(e.key, ':', CAST(round(e.value * 100) AS BIGINT))), ',')"))


_UTILITY = "grid_cell_id, hour, time_saved, search_time, benefit, expected_cost, net_benefit, violator_risk_score, adaptation_response"


@query("violator_utility", f"SELECT {_UTILITY} FROM t_utility",
       ["time_saved", "search_time", "benefit", "expected_cost", "net_benefit", "violator_risk_score"])
def violator_utility(spark, folder):
    return risk.violator_utility(patrol_table(spark, folder)).select(*_UTILITY.split(", "))


@query("adaptation_distribution", "SELECT adaptation_response, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM t_utility) AS DOUBLE) * 100 AS pct FROM t_utility GROUP BY adaptation_response", ["pct"])
def adaptation_distribution(spark, folder):
    return risk.distribution(materialise(risk.violator_utility(patrol_table(spark, folder)), "utility"), "adaptation_response")


@query("hourly_utility_export", "SELECT hour, grid_lat AS lat, grid_lon AS lon, violator_risk_score AS vrs, adaptation_response AS resp FROM t_utility", {"lat": 6, "lon": 6, "vrs": 4})
def hourly_utility_export(spark, folder):
    return risk.violator_utility(patrol_table(spark, folder)).select(
        "hour", F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"),
        F.col("violator_risk_score").alias("vrs"), F.col("adaptation_response").alias("resp"))


@query("peak_hour_leaders", f"""
SELECT grid_cell_id, round(avg(patrol_probability), 9) AS avg_p, avg(risk_score) AS avg_risk FROM t_patrol WHERE hour {_PEAK}
GROUP BY grid_cell_id ORDER BY avg_p DESC, grid_cell_id LIMIT 10""", {"avg_p": 9, "avg_risk": 6})
def peak_hour_leaders(spark, folder):
    return risk.peak_leaders(patrol_table(spark, folder))


@query("hour_probability_sum", "SELECT hour, sum(patrol_probability) AS total FROM t_patrol GROUP BY hour", ["total"])
def hour_probability_sum(spark, folder):
    return patrol_table(spark, folder).groupBy("hour").agg(F.sum("patrol_probability").alias("total"))


def cell_table(spark, folder):
    return hour_table(spark, folder).select("grid_cell_id", "cell_i", "cell_j").distinct()


@query("cell_knn_graph", "SELECT * FROM t_knn")
def cell_knn_graph(spark, folder):
    return neighbours.cell_graph(cell_table(spark, folder))


@query("moore_neighbours", """
SELECT a.grid_cell_id AS src, b.grid_cell_id AS dst FROM t_cells a JOIN t_cells b
ON abs(a.cell_i - b.cell_i) <= 1 AND abs(a.cell_j - b.cell_j) <= 1 AND a.grid_cell_id <> b.grid_cell_id""")
def moore_neighbours(spark, folder):
    return neighbours.moore_edges(cell_table(spark, folder))


def displacement_tables(spark, folder):
    patrol = ranked_input(spark, folder)
    edges = materialise(neighbours.cell_graph(cell_table(spark, folder)), "edges")
    hot = materialise(displacement.patrolled_rows(patrol), "hot")
    utility = risk.violator_utility(patrol)
    eligible = utility.where(F.col("adaptation_response").isin("park_illegally", "uncertain")).select("hour", "grid_cell_id")
    return displacement.displaced(patrol, hot, edges, eligible), hot, edges


@query("patrolled_cells", "SELECT * FROM t_hot")
def patrolled_cells(spark, folder):
    return displacement.patrolled_rows(ranked_input(spark, folder))


@query("second_hop_cells", """
SELECT DISTINCT grid_cell_id AS id FROM (SELECT k.dst AS grid_cell_id FROM (
  SELECT DISTINCT dst FROM t_knn WHERE src IN (SELECT grid_cell_id FROM t_hot WHERE hour = 9) AND dst NOT IN (SELECT grid_cell_id FROM t_hot WHERE hour = 9)) f
  JOIN t_knn k ON k.src = f.dst)
WHERE grid_cell_id NOT IN (SELECT grid_cell_id FROM t_hot WHERE hour = 9)
  AND grid_cell_id NOT IN (SELECT dst FROM t_knn WHERE src IN (SELECT grid_cell_id FROM t_hot WHERE hour = 9))""")
def second_hop_cells(spark, folder):
    edges = materialise(neighbours.cell_graph(cell_table(spark, folder)), "edges")
    hot = displacement.patrolled_rows(ranked_input(spark, folder).where(F.col("hour") == 9))
    return neighbours.second_hop(edges, hot.select(F.col("grid_cell_id").alias("id")))


_SPILL = "grid_cell_id, hour, original_risk, adjusted_risk, spillover_type, risk_change_pct, magnitude, lost_risk"


@query("hourly_displacement", f"SELECT {_SPILL} FROM t_spill", {"original_risk": 6, "adjusted_risk": 5, "risk_change_pct": 4, "magnitude": 5, "lost_risk": 5})
def hourly_displacement(spark, folder):
    return displacement_tables(spark, folder)[0].select(*_SPILL.split(", "))


@query("displacement_summary", """
SELECT spillover_type, count(*) AS n, avg(risk_change_pct) AS mean_change_pct, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM t_spill) AS DOUBLE) * 100 AS pct
FROM t_spill GROUP BY spillover_type""", {"mean_change_pct": 4, "pct": 6})
def displacement_summary(spark, folder):
    return displacement.summary(materialise(displacement_tables(spark, folder)[0], "displaced"))


@query("displacement_arrows", "SELECT * FROM t_arrow", ["magnitude"])
def displacement_arrows(spark, folder):
    return displacement.arrows(*displacement_tables(spark, folder))


@query("top_displacement_arrows", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY magnitude DESC, to_cell) AS place FROM t_arrow) WHERE place <= 50""", ["magnitude"])
def top_displacement_arrows(spark, folder):
    return displacement.top_arrows(displacement.arrows(*displacement_tables(spark, folder)))


@query("displacement_invariants", f"""
SELECT CAST(sum(CASE WHEN adjusted_risk < 0 OR adjusted_risk > 100 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range,
  CAST(sum(CASE WHEN spillover_type = 'patrolled' AND adjusted_risk > original_risk THEN 1 ELSE 0 END) AS BIGINT) AS patrolled_up,
  CAST(sum(CASE WHEN spillover_type = 'neighbor_1' AND adjusted_risk < original_risk THEN 1 ELSE 0 END) AS BIGINT) AS neighbour_down FROM t_spill""")
def displacement_invariants(spark, folder):
    from kerbflow.operators import checks

    return checks.displacement(displacement_tables(spark, folder)[0])
