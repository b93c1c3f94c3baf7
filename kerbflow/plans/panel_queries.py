"""Panels, features, forecasts and their evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kerbflow.functions import geo
from kerbflow.functions import labels as L
from kerbflow.operators import ensemble, forecast, neighbours, panel, poisson_trees, scoring, stats, zones
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import d, define, rounded
from kerbflow.plans.risk_queries import cleaned
from kerbflow.plans.serving_queries import centres, observed
from kerbflow.session import materialise, shared_path
from kerbflow.sources.adapter import table

VAL, TEST = "2024-01-20", "2024-01-25"

define("t_daily", "SELECT zone_id, CAST(local_ts AS DATE) AS date, count(*) AS violation_count FROM t_placed WHERE hour(local_ts) < 16 GROUP BY ALL")


def _panel_sql(source: str, unit: str) -> str:
    return f"""
SELECT *, coalesce(CAST(lag(violation_count, 1) OVER w AS DOUBLE), 0) AS lag_1d, coalesce(CAST(lag(violation_count, 7) OVER w AS DOUBLE), 0) AS lag_7d,
  coalesce(avg(violation_count) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_7d,
  coalesce(avg(violation_count) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_14d,
  coalesce(stddev_samp(violation_count) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_7d,
  coalesce(avg(violation_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS zone_expanding_mean,
  isodow(date) - 1 AS dow, month(date) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT u.{unit}, u.date, coalesce(v.violation_count, 0) AS violation_count FROM (
    SELECT {unit}, CAST(unnest(generate_series((SELECT min(date) FROM {source}), (SELECT max(date) FROM {source}), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT {unit} FROM {source})) u
  LEFT JOIN {source} v ON v.{unit} = u.{unit} AND v.date = u.date)
WINDOW w AS (PARTITION BY {unit} ORDER BY date)"""


define("t_daypanel", _panel_sql("t_daily", "zone_id"))
define("t_ship", "SELECT s_nationkey AS unit, CAST(l_shipdate AS DATE) AS date, count(*) AS violation_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
define("t_shippanel", _panel_sql("t_ship", "unit"))
_DAY = "lag_1d, lag_7d, rolling_mean_7d, rolling_mean_14d, rolling_std_7d, zone_expanding_mean"
_DAYF = dict.fromkeys(_DAY.split(", "), 6)


def stored_daily(spark, folder):
    return T.once(spark, folder, "daily", lambda: panel.daily_counts(T.facts(spark, folder)))


def day_table(spark, folder, daily=None):
    daily = stored_daily(spark, folder) if daily is None else daily
    return panel.day_features(panel.day_panel(daily))


@query("daily_counts", "SELECT zone_id, CAST(date AS VARCHAR) AS date, violation_count FROM t_daily")
def daily_counts(spark, folder):
    return panel.daily_counts(T.facts(spark, folder)).withColumn("date", F.col("date").cast("string"))


@query("day_panel", f"SELECT zone_id, CAST(date AS VARCHAR) AS date, violation_count, {_DAY}, dow, month, is_weekend FROM t_daypanel", _DAYF)
def day_panel(spark, folder):
    return day_table(spark, folder).withColumn("date", F.col("date").cast("string"))


def shipments(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"))
    counted = lines.groupBy("l_suppkey", "date").agg(F.count("*").alias("n"))  # shrink before the join
    joined = counted.join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("unit")), "l_suppkey")
    return joined.groupBy("unit", "date").agg(F.sum("n").alias("violation_count"))


@query("shipment_day_panel", f"SELECT unit, CAST(date AS VARCHAR) AS date, violation_count, {_DAY}, dow, month, is_weekend FROM t_shippanel", _DAYF)
def shipment_day_panel(spark, folder):
    daily = materialise(shipments(spark, folder), "shipments")
    rows = panel.day_features(panel.day_panel(daily, "unit"), "unit")
    return rows.withColumn("date", F.col("date").cast("string"))


define("t_next", f"""
SELECT zone_id, sum(CASE WHEN age = 0 THEN n ELSE 0 END) AS lag_1d, sum(CASE WHEN age = 6 THEN n ELSE 0 END) AS lag_7d,
  avg(CASE WHEN age < 7 THEN n END) AS rolling_mean_7d, avg(CASE WHEN age < 14 THEN n END) AS rolling_mean_14d,
  coalesce(stddev_samp(CASE WHEN age < 7 THEN n END), 0) AS rolling_std_7d, avg(n) AS zone_expanding_mean
FROM (SELECT zone_id, CAST(violation_count AS DOUBLE) AS n, date_diff('day', date, max(date) OVER ()) AS age FROM t_daypanel) GROUP BY zone_id""")


@query("next_day_features", f"SELECT zone_id, {_DAY}, (SELECT CAST(max(date) + 1 AS VARCHAR) FROM t_daily) AS date FROM t_next", _DAYF)
def next_day_features(spark, folder):
    rows = panel.next_day(stored_daily(spark, folder))
    return rows.select("zone_id", *_DAY.split(", "), F.col("date").cast("string").alias("date"))


def zone_edges(spark, folder, daily):
    """Three nearest zones among those with a day series."""
    kept = centres(spark, folder).join(daily.select("zone_id").distinct(), "zone_id", "left_semi")
    return materialise(neighbours.zone_graph(kept, 3), "zone-edges")


_HAV = f"{d(12742000.0)} * asin(sqrt(sin(radians(b.lat - a.lat) / 2) * sin(radians(b.lat - a.lat) / 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) * sin(radians(b.lon - a.lon) / 2)))"
define("t_zedge", f"""
SELECT a.zone_id AS src, b.zone_id AS dst, {_HAV} AS dist, row_number() OVER (PARTITION BY a.zone_id ORDER BY {_HAV}, b.zone_id) AS place
FROM (SELECT * FROM t_centre WHERE zone_id IN (SELECT zone_id FROM t_daily)) a, (SELECT * FROM t_centre WHERE zone_id IN (SELECT zone_id FROM t_daily)) b
WHERE a.zone_id <> b.zone_id QUALIFY place <= 3""")


@query("zone_knn_graph", "SELECT * FROM t_zedge", {"dist": 3})
def zone_knn_graph(spark, folder):
    return zone_edges(spark, folder, stored_daily(spark, folder))


define("t_times", "SELECT src, dst, CAST(60 + ('0x' || substr(md5(src || dst), 1, 8))::BIGINT % 600 AS DOUBLE) AS seconds FROM t_zedge")


@query("travel_time_neighbours", "SELECT src, dst, seconds, row_number() OVER (PARTITION BY src ORDER BY seconds, dst) AS place FROM t_times QUALIFY place <= 2", ["seconds"])
def travel_time_neighbours(spark, folder):
    edges = zone_edges(spark, folder, stored_daily(spark, folder))
    times = edges.selectExpr("src", "dst", "CAST(60 + CAST(conv(substr(md5(concat(src, dst)), 1, 8), 16, 10) AS BIGINT) % 600 AS DOUBLE) AS seconds")
    return neighbours.by_travel_time(edges, times, 2).drop("dist")


@query("neighbour_day_lag", """
SELECT p.zone_id, CAST(p.date AS VARCHAR) AS date, coalesce((SELECT avg(q.lag_1d) FROM t_zedge e JOIN t_daypanel q ON q.zone_id = e.dst WHERE e.src = p.zone_id AND q.date = p.date), 0) AS neighbor_spatial_lag
FROM t_daypanel p""", ["neighbor_spatial_lag"])
def neighbour_day_lag(spark, folder):
    daily = stored_daily(spark, folder)
    edges = zone_edges(spark, folder, daily)
    rows = panel.neighbour_lag(panel.day_panel(daily), daily, edges)
    return rows.select("zone_id", F.col("date").cast("string").alias("date"), "neighbor_spatial_lag")


@query("next_day_neighbour_lag", "SELECT n.zone_id, coalesce((SELECT avg(m.lag_1d) FROM t_zedge e JOIN t_next m ON m.zone_id = e.dst WHERE e.src = n.zone_id), 0) AS neighbor_spatial_lag FROM t_next n", ["neighbor_spatial_lag"])
def next_day_neighbour_lag(spark, folder):
    daily = stored_daily(spark, folder)
    rows = panel.neighbour_lag(panel.next_day(daily), daily, zone_edges(spark, folder, daily))
    return rows.select("zone_id", "neighbor_spatial_lag")


define("t_hourly", "SELECT cell_i || '_' || cell_j AS grid_cell_id, cell_i, cell_j, ts, count(*) AS n FROM (SELECT CAST(floor(latitude / CAST(0.005 AS DOUBLE)) AS BIGINT) AS cell_i, CAST(floor(longitude / CAST(0.005 AS DOUBLE)) AS BIGINT) AS cell_j, date_trunc('hour', local_ts) AS ts FROM t_viol) GROUP BY ALL")
define("t_hourpanel", """
SELECT u.grid_cell_id, u.cell_i, u.cell_j, u.ts, coalesce(h.n, 0) AS violation_count FROM (
  SELECT grid_cell_id, cell_i, cell_j, unnest(generate_series((SELECT min(ts) FROM t_hourly), (SELECT max(ts) FROM t_hourly), INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT grid_cell_id, cell_i, cell_j FROM t_hourly)) u
LEFT JOIN t_hourly h ON h.grid_cell_id = u.grid_cell_id AND h.ts = u.ts""")
define("t_hourfeat", f"""
SELECT *, CASE WHEN rolling_mean_168h > 0 THEN lag_1 / rolling_mean_168h ELSE {d(1.0)} END AS violation_rate FROM (
  SELECT *, CAST(lag(violation_count, 1) OVER w AS DOUBLE) AS lag_1, CAST(lag(violation_count, 24) OVER w AS DOUBLE) AS lag_24, CAST(lag(violation_count, 168) OVER w AS DOUBLE) AS lag_168,
    coalesce(avg(violation_count) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_24h, coalesce(stddev_samp(violation_count) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_24h,
    coalesce(avg(violation_count) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_168h, coalesce(stddev_samp(violation_count) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_168h
  FROM t_hourpanel WINDOW w AS (PARTITION BY grid_cell_id ORDER BY ts))""")
_HOUR = ["lag_1", "lag_24", "lag_168", "rolling_mean_24h", "rolling_std_24h", "rolling_mean_168h", "rolling_std_168h", "violation_rate"]


def stored_hourly(spark, folder):
    return T.once(spark, folder, "hourly", lambda: panel.hourly_counts(cleaned(spark, folder)))


@query("hour_panel_features", f"SELECT grid_cell_id, CAST(ts AS VARCHAR) AS ts, violation_count, {', '.join(_HOUR)} FROM t_hourfeat", _HOUR)
def hour_panel_features(spark, folder):
    rows = panel.hour_features(panel.hour_panel(stored_hourly(spark, folder)))
    return rows.select("grid_cell_id", F.col("ts").cast("string").alias("ts"), "violation_count", *_HOUR)


@query("spatial_lag", """
SELECT p.grid_cell_id, CAST(p.ts AS VARCHAR) AS ts, CASE WHEN g.degree > 0 THEN coalesce(s.sent, 0) / CAST(g.degree AS DOUBLE) ELSE 0 END AS spatial_lag_1 FROM t_hourpanel p
LEFT JOIN (SELECT a.grid_cell_id, count(*) AS degree FROM (SELECT DISTINCT grid_cell_id, cell_i, cell_j FROM t_hourly) a JOIN (SELECT DISTINCT grid_cell_id, cell_i, cell_j FROM t_hourly) b
  ON abs(a.cell_i - b.cell_i) <= 1 AND abs(a.cell_j - b.cell_j) <= 1 AND a.grid_cell_id <> b.grid_cell_id GROUP BY a.grid_cell_id) g ON g.grid_cell_id = p.grid_cell_id
LEFT JOIN (SELECT a.grid_cell_id, b.ts + INTERVAL 1 HOUR AS ts, sum(b.n) AS sent FROM (SELECT DISTINCT grid_cell_id, cell_i, cell_j FROM t_hourly) a JOIN t_hourly b
  ON abs(a.cell_i - b.cell_i) <= 1 AND abs(a.cell_j - b.cell_j) <= 1 AND a.grid_cell_id <> b.grid_cell_id GROUP BY ALL) s ON s.grid_cell_id = p.grid_cell_id AND s.ts = p.ts""", ["spatial_lag_1"])
def spatial_lag(spark, folder):
    counts = stored_hourly(spark, folder)
    rows = panel.spatial_lag(panel.hour_panel(counts), counts)
    return rows.select("grid_cell_id", F.col("ts").cast("string").alias("ts"), "spatial_lag_1")


define("t_meta", """
SELECT grid_cell_id, avg(vehicle_severity) AS mean_vehicle_severity, avg(validation_trust) AS mean_validation_trust,
  avg(CASE WHEN vehicle_severity >= 0.6 THEN 1.0 ELSE 0.0 END) AS heavy_vehicle_ratio,
  CASE WHEN sum(CASE WHEN junction_name IS NOT NULL AND junction_name <> 'No Junction' THEN 1 ELSE 0 END) > count(*) / 2.0 THEN 1 ELSE 0 END AS junction_flag FROM t_clean GROUP BY grid_cell_id""")
_META = ["mean_vehicle_severity", "mean_validation_trust", "heavy_vehicle_ratio"]


@query("cell_metadata", "SELECT * FROM t_meta", _META)
def cell_metadata(spark, folder):
    return panel.cell_metadata(cleaned(spark, folder))


_TURN = {"hour": ("hour(ts)", 24), "dow": ("(isodow(ts) - 1)", 7), "month": ("month(ts)", 12)}
_CYC = [f"{fn}_{name}" for name in _TURN for fn in ("sin", "cos")]


@query("cyclic_encodings", "SELECT DISTINCT hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month, " + ", ".join(
    f"{fn}({d(2 * math.pi)} * {expr} / {d(float(n))}) AS {fn}_{name}" for name, (expr, n) in _TURN.items() for fn in ("sin", "cos")) + " FROM t_hourly", _CYC)
def cyclic_encodings(spark, folder):
    hours = panel.hourly_counts(cleaned(spark, folder)).select(
        F.hour("ts").alias("hour"), F.weekday("ts").alias("day_of_week"), F.month("ts").alias("month")).distinct()
    return panel.cyclic(hours)


def stored_features(spark, folder):
    """The hourly feature table, stored by date once a run."""
    table = panel.feature_matrix(cleaned(spark, folder), stored_hourly(spark, folder))
    path = shared_path(spark, "hourly-features")
    panel.store_features(table, path)
    return spark.read.schema(table.schema).parquet(path)


@query("hourly_model_rows", f"""
SELECT p.grid_cell_id, CAST(p.ts AS VARCHAR) AS ts, p.violation_count, lag_1, lag_24, lag_168, coalesce(mean_vehicle_severity, 0) AS mean_vehicle_severity, coalesce(junction_flag, 0) AS junction_flag
FROM t_hourfeat p LEFT JOIN t_meta m ON m.grid_cell_id = p.grid_cell_id WHERE CAST(p.ts AS DATE) >= DATE '{TEST}' AND lag_168 IS NOT NULL""", ["lag_1", "lag_24", "lag_168", "mean_vehicle_severity"])
def hourly_model_rows(spark, folder):
    columns = ["grid_cell_id", "ts", "violation_count", "lag_1", "lag_24", "lag_168", "mean_vehicle_severity", "junction_flag"]
    rows = panel.load_split(stored_features(spark, folder), columns, first=TEST)
    return rows.withColumn("ts", F.col("ts").cast("string"))


@query("chronological_split", f"SELECT CASE WHEN date < DATE '{VAL}' THEN 'train' WHEN date < DATE '{TEST}' THEN 'val' ELSE 'test' END AS split, count(*) AS n, CAST(sum(violation_count) AS BIGINT) AS total FROM t_daypanel GROUP BY 1")
def chronological_split(spark, folder):
    rows = panel.day_panel(stored_daily(spark, folder))
    return rows.groupBy(panel.day_split(F.col("date"), VAL, TEST).alias("split")).agg(F.count("*").alias("n"), F.sum("violation_count").alias("total"))


define("t_fc", f"""
SELECT *, (rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / {d(2.0)}) / count(*) OVER () AS pct FROM (SELECT zone_id, {rounded('rolling_mean_14d', 9)} AS pred FROM t_next)""")


@query("forecast_intervals", f"""
SELECT zone_id, pred AS predicted_count, pct * {d(100.0)} AS predicted_risk, CASE WHEN pct >= 0.9 THEN 'CRITICAL' WHEN pct >= 0.7 THEN 'SEVERE' WHEN pct >= 0.4 THEN 'MODERATE' ELSE 'MINIMAL' END AS predicted_band,
  greatest({d(0.0)}, pred - {d(1.96)} * sqrt(pred)) AS confidence_lower, pred + {d(1.96)} * sqrt(pred) AS confidence_upper FROM t_fc""",
       ["predicted_count", "predicted_risk", "confidence_lower", "confidence_upper"])
def forecast_intervals(spark, folder):
    from kerbflow.functions.basics import half_up

    rows = panel.next_day(stored_daily(spark, folder)).select("zone_id", half_up(F.col("rolling_mean_14d"), 9).alias("pred"))
    return panel.forecast_rows(materialise(rows, "next-day"))


@query("forecast_leaders", "SELECT zone_id, pred AS predicted_count, row_number() OVER (ORDER BY pred DESC, zone_id) AS place FROM t_fc QUALIFY place <= 10", ["predicted_count"])
def forecast_leaders(spark, folder):
    from kerbflow.functions.basics import half_up
    from kerbflow.operators.serving import best

    rows = panel.next_day(stored_daily(spark, folder)).select("zone_id", half_up(F.col("rolling_mean_14d"), 9).alias("predicted_count"))
    return best(rows, 10, F.col("predicted_count").desc(), F.col("zone_id"))


define("t_eval", f"SELECT zone_id, date, violation_count AS actual, {rounded('rolling_mean_7d', 9)} AS a, {rounded('zone_expanding_mean', 9)} AS b FROM t_daypanel WHERE date >= DATE '{TEST}'")


def evaluation(spark, folder, condition=f"date >= DATE'{TEST}'"):
    """Two simple predictions of the day panel, so that metrics can be checked exactly."""
    from kerbflow.functions.basics import half_up

    rows = day_table(spark, folder).where(condition)
    return rows.select("zone_id", "date", F.col("violation_count").alias("actual"), half_up(F.col("rolling_mean_7d"), 9).alias("a"),
                       half_up(F.col("zone_expanding_mean"), 9).alias("b"))


def _precision_sql(source: str, pred: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}avg(hits / CAST(10 AS DOUBLE)) AS precision, count(*) AS groups FROM (
  SELECT {k}date, CAST(sum(CASE WHEN ra <= 10 AND rp <= 10 THEN 1 ELSE 0 END) AS DOUBLE) AS hits FROM (
    SELECT *, row_number() OVER (PARTITION BY {k}date ORDER BY actual DESC, zone_id) AS ra, row_number() OVER (PARTITION BY {k}date ORDER BY {pred} DESC, zone_id) AS rp FROM {source})
  GROUP BY {k}date HAVING count(*) >= 10 AND sum(actual) > 0) {('GROUP BY ' + keys) if keys else ''}"""


@query("daily_precision_at_k", _precision_sql("t_eval", "a"), ["precision"])
def daily_precision_at_k(spark, folder):
    return stats.precision_at_k(materialise(evaluation(spark, folder), "evaluation"), ["date"], "zone_id", "actual", "a", 10, (), True)


@query("top_k_overlap", f"""
SELECT CAST(date AS VARCHAR) AS date, sum(CASE WHEN ra <= 10 AND rp <= 10 THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS precision, 1 AS groups FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY actual DESC, zone_id) AS ra, row_number() OVER (PARTITION BY date ORDER BY a DESC, zone_id) AS rp FROM t_eval) GROUP BY date""", ["precision"])
def top_k_overlap(spark, folder):
    rows = materialise(evaluation(spark, folder), "evaluation")
    return stats.precision_at_k(rows, [], "zone_id", "actual", "a", 10, ["date"]).withColumn("date", F.col("date").cast("string"))


@query("error_metrics", """
SELECT count(*) AS n, avg(abs(a - actual)) AS mae, sqrt(avg((a - actual) * (a - actual))) AS rmse, 1 - avg((a - actual) * (a - actual)) / var_pop(CAST(actual AS DOUBLE)) AS r2 FROM t_eval""", ["mae", "rmse", "r2"])
def error_metrics(spark, folder):
    return stats.errors(evaluation(spark, folder), "actual", "a")


@query("daily_totals", "SELECT zone_id, CAST(sum(actual) AS BIGINT) AS actual, sum(a) AS predicted FROM t_eval GROUP BY zone_id", ["predicted"])
def daily_totals(spark, folder):
    return evaluation(spark, folder).groupBy("zone_id").agg(F.sum("actual").alias("actual"), F.sum("a").alias("predicted"))


@query("date_zone_totals", "SELECT date, zone_id, CAST(sum(actual) AS BIGINT) AS actual, sum(a) AS predicted FROM t_eval GROUP BY date, zone_id", ["predicted"])
def date_zone_totals(spark, folder):
    return evaluation(spark, folder).groupBy("date", "zone_id").agg(F.sum("actual").alias("actual"), F.sum("a").alias("predicted"))


define("t_capped", " UNION ALL ".join(
    f"SELECT quantile_cont(CAST(violation_count AS DOUBLE), {q}) AS cap FROM t_daypanel WHERE date < DATE '{VAL}'" for q in (0.99, 0.995, 0.999, 0.9995, 0.9999, 1.0)))
define("t_val", f"SELECT violation_count AS actual, {rounded('rolling_mean_7d', 9)} * 3 AS p FROM t_daypanel WHERE date >= DATE '{VAL}' AND date < DATE '{TEST}'")


@query("prediction_cap", f"""
SELECT cap, rmse, CASE WHEN row_number() OVER (ORDER BY rmse, cap) = 1 THEN 1 ELSE 0 END AS is_best FROM (
  SELECT cap, {rounded('sqrt(avg(pow(greatest(0, least(p, cap)) - actual, 2)))', 9)} AS rmse FROM t_val, (SELECT DISTINCT cap FROM t_capped) GROUP BY cap)""", ["cap", "rmse"])
def prediction_cap(spark, folder):
    rows = materialise(day_table(spark, folder), "day-panel")
    train = rows.where(f"date < DATE'{VAL}'").select(F.col("violation_count").alias("actual"))
    from kerbflow.functions.basics import half_up

    val = rows.where(f"date >= DATE'{VAL}' AND date < DATE'{TEST}'").select(
        F.col("violation_count").alias("actual"), (half_up(F.col("rolling_mean_7d"), 9) * 3).alias("p"))
    return stats.prediction_cap(train, val, "actual", "p")


define("t_mix", f"SELECT zone_id, date, actual, w / {d(20.0)} AS weight, {rounded(f'greatest((w / {d(20.0)}) * a + ({d(1.0)} - w / {d(20.0)}) * b, 0)', 9)} AS mixed FROM t_eval, (SELECT unnest(range(0, 21)) AS w)")


@query("blend_sweep", f"SELECT weight, precision, CASE WHEN row_number() OVER (ORDER BY {rounded('precision', 9)} DESC, weight) = 1 THEN 1 ELSE 0 END AS is_best FROM ({_precision_sql('t_mix', 'mixed', 'weight').replace(' AND sum(actual) > 0', '')})", ["weight", "precision"])
def blend_sweep(spark, folder):
    return stats.blend_sweep(materialise(evaluation(spark, folder), "evaluation"), ["date"], "zone_id", "actual", "a", "b")


def model_panel(spark, folder, daily):
    """Day panel with zone centres, neighbour lag and road rank, for the fitted models."""
    edges = zone_edges(spark, folder, daily)
    rows = panel.neighbour_lag(day_table(spark, folder, daily), daily, edges)
    speed = observed(spark, folder).select("zone_id", L.road_rank(F.col("free_flow_speed_kmph")).alias("road_size_proxy"))
    rows = rows.join(centres(spark, folder).select("zone_id", "lat", "lon"), "zone_id").join(speed, "zone_id", "left")
    rows = rows.withColumns({"road_size_proxy": F.coalesce("road_size_proxy", F.lit(0)), "split": panel.day_split(F.col("date"), VAL, TEST)})
    return materialise(rows, "model-panel"), edges, speed


@query("day_forecast_metrics")
def day_forecast_metrics(spark, folder):
    rows, _, _ = model_panel(spark, folder, stored_daily(spark, folder))
    return forecast.day_model(rows, panel.DAY_FEATURES)[1]


@query("day_tree_metrics")
def day_tree_metrics(spark, folder):
    rows, _, _ = model_panel(spark, folder, stored_daily(spark, folder))
    return forecast.tree_quality(materialise(rows, "day-rows"), panel.DAY_FEATURES)


@query("next_day_tree_forecast")
def next_day_tree_forecast(spark, folder):
    daily = stored_daily(spark, folder)
    rows, edges, speed = model_panel(spark, folder, daily)
    model = poisson_trees.fit(materialise(rows, "day-rows"), panel.DAY_FEATURES + panel.SPACE_FEATURES)
    future = poisson_trees.predict(model, next_rows(spark, folder, daily, edges, speed), ["zone_id"])
    return panel.forecast_rows(materialise(future, "next-day"))


def next_rows(spark, folder, daily, edges, speed):
    future = panel.neighbour_lag(panel.next_day(daily), daily, edges)
    future = future.join(centres(spark, folder).select("zone_id", "lat", "lon"), "zone_id").join(speed, "zone_id", "left")
    return future.withColumn("road_size_proxy", F.coalesce("road_size_proxy", F.lit(0)))


@query("next_day_forecast")
def next_day_forecast(spark, folder):
    daily = stored_daily(spark, folder)
    rows, edges, speed = model_panel(spark, folder, daily)
    features = panel.DAY_FEATURES + panel.SPACE_FEATURES
    model = forecast.poisson_model(rows.where("split <> 'test'"), features)
    future = forecast.poisson_predict(model, next_rows(spark, folder, daily, edges, speed))
    return panel.forecast_rows(materialise(future.select("zone_id", "pred"), "next-day"))


@query("forecast_comparison")
def forecast_comparison(spark, folder):
    rows, _, _ = model_panel(spark, folder, stored_daily(spark, folder))
    return forecast.compare_models(rows, panel.DAY_FEATURES, panel.DAY_FEATURES + panel.SPACE_FEATURES)


@query("forecast_contributions")
def forecast_contributions(spark, folder):
    daily = stored_daily(spark, folder)
    rows, edges, speed = model_panel(spark, folder, daily)
    model = forecast.poisson_model(rows.where("split <> 'test'"), panel.DAY_FEATURES)
    return forecast.contributions(model, next_rows(spark, folder, daily, edges, speed))


_HOURLY = ["lag_1", "lag_24", "lag_168", "rolling_mean_24h", "rolling_std_24h", "rolling_mean_168h", "rolling_std_168h", "violation_rate", "spatial_lag_1",
           "sin_hour", "cos_hour", "sin_dow", "cos_dow", "mean_vehicle_severity", "mean_validation_trust", "heavy_vehicle_ratio", "junction_flag"]


def hourly_models(spark, folder):
    """Training rows, and predictions of models that learned from training rows alone."""
    stored = stored_features(spark, folder)
    columns = ["grid_cell_id", "date", "hour", "violation_count", *_HOURLY]
    train, val, later = panel.load_split(stored, columns, before=VAL), panel.load_split(stored, columns, VAL, TEST), panel.load_split(stored, columns, VAL)
    poisson = forecast.poisson_model(train, _HOURLY)
    place = ["grid_cell_id", "date", "hour"]  # files of the stored table come in any order
    trees = forecast.stopped_model(forecast.in_order(train, place), forecast.in_order(val, place), _HOURLY, rounds=20)
    both = forecast.boosted_predict(trees, forecast.poisson_predict(poisson, later, "p"), _HOURLY, "q")
    kept = both.select(F.col("grid_cell_id").alias("zone_id"), "date", "hour", panel.day_split(F.col("date"), VAL, TEST).alias("split"), F.col("violation_count").alias("actual"), "p", "q")
    return train, materialise(kept, "hour-predictions"), trees


@query("hourly_ensemble_metrics")
def hourly_ensemble_metrics(spark, folder):
    train, made, _ = hourly_models(spark, folder)
    caps, weight = ensemble.tuned(made, train.select(F.col("violation_count").alias("actual")))
    return ensemble.evaluated(made, caps, weight)


define("t_ens", f"""
SELECT grid_cell_id AS zone_id, CAST(ts AS DATE) AS date, hour(ts) AS hour, violation_count AS actual, {rounded('rolling_mean_24h * 3', 9)} AS p, lag_24 AS q,
  CASE WHEN CAST(ts AS DATE) < DATE '{VAL}' THEN 'train' WHEN CAST(ts AS DATE) < DATE '{TEST}' THEN 'val' ELSE 'test' END AS split FROM t_hourfeat WHERE lag_168 IS NOT NULL""")
define("t_enslevel", " UNION ".join(f"SELECT quantile_cont(CAST(actual AS DOUBLE), {q}) AS cap FROM t_ens WHERE split = 'train'" for q in (0.99, 0.995, 0.999, 0.9995, 0.9999, 1.0)))
define("t_enscap", "SELECT " + ", ".join(f"""(SELECT cap FROM (SELECT cap, {rounded(f'sqrt(avg(pow(greatest(0, least({c}, cap)) - actual, 2)))', 9)} AS rmse FROM t_ens, t_enslevel WHERE split = 'val' GROUP BY cap)
  ORDER BY rmse, cap LIMIT 1) AS cap_{c}""" for c in ("p", "q")))
define("t_enscapped", "SELECT zone_id, date, hour, actual, split, least(p, cap_p) AS p, least(q, cap_q) AS q, greatest(cap_p, cap_q) AS top FROM t_ens, t_enscap")
define("t_ensday", f"SELECT date, zone_id, sum(actual) AS actual, {rounded('sum(p)', 9)} AS a, {rounded('sum(q)', 9)} AS b FROM t_enscapped WHERE split = 'val' AND hour < 16 GROUP BY ALL")
define("t_ensmix", f"SELECT zone_id, date, actual, w / {d(20.0)} AS weight, {rounded(f'greatest((w / {d(20.0)}) * a + ({d(1.0)} - w / {d(20.0)}) * b, 0)', 9)} AS mixed FROM t_ensday, (SELECT unnest(range(0, 21)) AS w)")
define("t_ensweight", f"SELECT weight FROM ({_precision_sql('t_ensmix', 'mixed', 'weight').replace(' AND sum(actual) > 0', '')}) ORDER BY {rounded('precision', 9)} DESC, weight LIMIT 1")
_MIXED = rounded(f"least(greatest(weight * p + ({d(1.0)} - weight) * q, 0), top)", 9)
_TESTED = " UNION ALL ".join(
    f"SELECT zone_id, date, hour, actual, '{model}' AS model, {value} AS pred, '{scope}' AS scope FROM t_enscapped, t_ensweight WHERE split = 'test'{more}"
    for model, value in (("first", "p"), ("second", "q"), ("blend", _MIXED)) for scope, more in (("all", ""), ("data_rich", " AND hour < 16")))
define("t_enstest", _TESTED)
define("t_ensdaily", f"SELECT model, scope, date, zone_id, sum(actual) AS actual, {rounded('sum(pred)', 9)} AS pred FROM t_enstest GROUP BY ALL")


@query("ensemble_metrics", f"""
SELECT e.model, e.scope, n, mae, rmse, r2, a.precision AS precision_daily, b.precision AS precision_hourly, cap_p AS first_cap, cap_q AS second_cap, weight AS blend_weight
FROM (SELECT model, scope, count(*) AS n, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse, 1 - avg((pred - actual) * (pred - actual)) / var_pop(CAST(actual AS DOUBLE)) AS r2 FROM t_enstest GROUP BY ALL) e
LEFT JOIN ({_precision_sql('t_ensdaily', 'pred', 'model, scope')}) a ON a.model = e.model AND a.scope = e.scope
LEFT JOIN ({_precision_sql('t_enstest', 'pred', 'model, scope').replace('scope, date', 'scope, date, hour')}) b ON b.model = e.model AND b.scope = e.scope, t_enscap, t_ensweight""",
       ["mae", "rmse", "r2", "precision_daily", "precision_hourly", "first_cap", "second_cap", "blend_weight"])
def ensemble_metrics(spark, folder):
    """The ensemble's tuning and evaluation over two plain predictions, so that every column has a twin."""
    from kerbflow.functions.basics import half_up

    rows = panel.hour_features(panel.hour_panel(stored_hourly(spark, folder))).where("lag_168 IS NOT NULL").withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    made = rows.select(F.col("grid_cell_id").alias("zone_id"), "date", "hour", F.col("violation_count").alias("actual"), half_up(F.col("rolling_mean_24h") * 3, 9).alias("p"),
                       F.col("lag_24").alias("q"), panel.day_split(F.col("date"), VAL, TEST).alias("split"))
    made = materialise(made, "plain-predictions")
    caps, weight = ensemble.tuned(made, made.where("split = 'train'").select("actual"))
    return ensemble.evaluated(made, caps, weight)


@query("feature_importance")
def feature_importance(spark, folder):
    return forecast.importance(hourly_models(spark, folder)[2], _HOURLY, spark)


@query("packed_ids", f"""
SELECT DISTINCT grid_cell_id, CAST(split_part(grid_cell_id, '_', 1) AS BIGINT) AS cell_row, CAST(split_part(grid_cell_id, '_', 2) AS BIGINT) AS cell_col,
  CAST(floor(CAST(split_part(grid_cell_id, '_', 1) AS DOUBLE) / {d(8.0)}) AS BIGINT) AS parent_row FROM t_hourly""")
def packed_ids(spark, folder):
    """Parts of packed cell ids, and the row of the cell's parent two levels up."""
    cells = stored_hourly(spark, folder).select("grid_cell_id").distinct()
    row = geo.cell_part(F.col("grid_cell_id"), 0)
    return cells.select("grid_cell_id", row.alias("cell_row"), geo.cell_part(F.col("grid_cell_id"), 1).alias("cell_col"), geo.zone_parent(row, 7).alias("parent_row"))
