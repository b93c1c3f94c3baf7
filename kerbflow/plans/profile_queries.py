"""Documented dataset analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import events as E
from kerbflow.functions import geo as G
from kerbflow.functions import vocabulary as V
from kerbflow.operators import profile, selection, zones
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import _vehicle, case_map, d, define, rounded
from kerbflow.plans.risk_queries import cleaned
from kerbflow.session import materialise

_COLUMNS = ["id", "latitude", "longitude", "location", "vehicle_number", "vehicle_type", "updated_vehicle_type", "violation_type", "created_datetime",
            "modified_datetime", "validation_timestamp", "police_station", "center_code", "device_id", "junction_name", "validation_status", "signal"]


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM t_viol" for c in _COLUMNS))
def column_profile(spark, folder):
    rows = T.facts(spark, folder)
    return profile.column_profile(rows, rows.columns)


@query("coordinate_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS axis, {d(q)} AS level, quantile_cont({c}, {q}) AS quantile FROM t_viol" for c in ("latitude", "longitude") for q in (0.0, 0.5, 1.0)), ["quantile"])
def coordinate_quantiles(spark, folder):
    axes = T.facts(spark, folder).select("latitude", "longitude").unpivot([], ["latitude", "longitude"], "axis", "value")
    return selection.quantiles(axes, "value", [0.0, 0.5, 1.0], ["axis"])


@query("pincode_share", "SELECT pincode, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM t_clean) AS pct FROM t_clean GROUP BY pincode", ["pct"])
def pincode_share(spark, folder):
    return profile.share(cleaned(spark, folder), "pincode")


@query("fine_cell_leaders", """
SELECT c.zone_id, c.n, s.station FROM (SELECT zone_id, count(*) AS n FROM t_placed GROUP BY zone_id ORDER BY n DESC, zone_id LIMIT 15) c
JOIN (SELECT zone_id, police_station AS station, row_number() OVER (PARTITION BY zone_id ORDER BY count(*) DESC, police_station) AS rn FROM t_placed GROUP BY zone_id, police_station) s ON s.zone_id = c.zone_id AND s.rn = 1""")
def fine_cell_leaders(spark, folder):
    placed = zones.place(T.facts(spark, folder))
    counted = materialise(placed.groupBy("zone_id", "police_station").agg(F.count("*").alias("n")), "zone-stations")
    top = counted.groupBy("zone_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("minus"), "police_station")).alias("best"))
    return top.orderBy(F.col("total").desc(), "zone_id").limit(15).select(
        "zone_id", F.col("total").alias("n"), F.col("best.police_station").alias("station"))


@query("zone_mode_station", "SELECT zone_id, time_bucket, station FROM t_station WHERE time_bucket <> 'all_day'")
def zone_mode_station(spark, folder):
    return zones.mode(zones.prepare(T.facts(spark, folder)), ["zone_id", "time_bucket"], "station", "station")


@query("zone_top_labels", "SELECT zone_id, time_bucket, label AS item, n, rn AS place FROM t_labels WHERE time_bucket <> 'all_day'")
def zone_top_labels(spark, folder):
    return zones.top_values(zones.prepare(T.facts(spark, folder)), ["zone_id", "time_bucket"], "labels")


_PARTS = {"month": "month", "day_of_week": "day_of_week", "hour": "hour", "time_bucket": "time_bucket"}


@query("calendar_counts", " UNION ALL ".join(f"SELECT '{k}' AS part, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM t_clean GROUP BY {c}" for k, c in _PARTS.items()))
def calendar_counts(spark, folder):
    text = cleaned(spark, folder).groupBy(*_PARTS).agg(F.count("*").alias("n"))  # one small cube, then one row per part
    items = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), F.col(name).cast("string").alias("value")) for name in _PARTS]))
    return text.select("n", items.alias("i")).groupBy("i.part", "i.value").agg(F.sum("n").alias("n"))


@query("daily_volume_quantiles", " UNION ALL ".join(
    f"SELECT {d(q)} AS level, quantile_cont(n, {q}) AS quantile FROM (SELECT count(*) AS n FROM t_clean GROUP BY date)" for q in (0.0, 0.1, 0.5, 0.9, 1.0)), ["quantile"])
def daily_volume_quantiles(spark, folder):
    daily = cleaned(spark, folder).groupBy("date").agg(F.count("*").alias("n"))
    return selection.quantiles(daily, "n", [0.0, 0.1, 0.5, 0.9, 1.0])


def labelled(spark, folder):
    return T.facts(spark, folder).select(E.label_list("violation_type").alias("labels"))


define("t_lists", "SELECT string_split(regexp_replace(violation_type, '[\\[\\]\"]', '', 'g'), ',') AS labels FROM t_viol")


@query("label_counts", "SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM t_lists) GROUP BY label")
def label_counts(spark, folder):
    return profile.label_counts(labelled(spark, folder))


@query("labels_per_row", "SELECT CAST(len(labels) AS INTEGER) AS labels_per_row, count(*) AS n FROM t_lists GROUP BY 1")
def labels_per_row(spark, folder):
    return profile.label_sizes(labelled(spark, folder))


@query("label_combinations", "SELECT array_to_string(labels, ' + ') AS combination, count(*) AS n FROM t_lists GROUP BY 1")
def label_combinations(spark, folder):
    return profile.label_combinations(labelled(spark, folder))


@query("vehicle_corrections", "SELECT vehicle_type, updated_vehicle_type, count(*) AS n FROM t_viol WHERE updated_vehicle_type <> 'NULL' AND updated_vehicle_type <> vehicle_type GROUP BY ALL")
def vehicle_corrections(spark, folder):
    return profile.vehicle_corrections(T.facts(spark, folder))


@query("repeat_vehicle_histogram", "SELECT records, count(*) AS vehicles FROM (SELECT count(*) AS records FROM t_viol GROUP BY vehicle_number) GROUP BY records")
def repeat_vehicle_histogram(spark, folder):
    return profile.repeat_histogram(T.facts(spark, folder))


@query("prior_vehicle_counts", "SELECT vehicle_number, CAST(date AS VARCHAR) AS date, n, " + ", ".join(
    f"CAST(coalesce(sum(n) OVER (PARTITION BY vehicle_number ORDER BY date RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS prior_{k}d" for k in (7, 30, 90))
       + " FROM (SELECT vehicle_number, CAST(local_ts AS DATE) AS date, count(*) AS n FROM t_viol GROUP BY ALL)")
def prior_vehicle_counts(spark, folder):
    timed = E.with_local_time(T.facts(spark, folder), "created_datetime")
    return profile.prior_counts(timed).withColumn("date", F.col("date").cast("string"))


@query("junction_share", "SELECT junction_name, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM t_viol) AS pct FROM t_viol GROUP BY junction_name", ["pct"])
def junction_share(spark, folder):
    return profile.share(T.facts(spark, folder), "junction_name")


@query("missing_centre_codes", "SELECT police_station, count(*) AS n FROM t_viol WHERE center_code IS NULL GROUP BY police_station")
def missing_centre_codes(spark, folder):
    return profile.missing_by(T.facts(spark, folder), "police_station", "center_code")


@query("status_share", "SELECT validation_status, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM t_viol) AS pct FROM t_viol GROUP BY validation_status", ["pct"])
def status_share(spark, folder):
    return profile.share(T.facts(spark, folder), "validation_status")


@query("status_by_month", "SELECT strftime(local_ts, '%Y-%m') AS month, coalesce(validation_status, 'missing') AS status, count(*) AS n FROM t_viol GROUP BY ALL")
def status_by_month(spark, folder):
    return profile.status_by_month(E.with_local_time(T.facts(spark, folder), "created_datetime"))


_DELAY = {"modified": "modified_datetime", "validation": "validation_timestamp"}


@query("workflow_latency", " UNION ALL ".join(
    f"SELECT '{k}' AS delay, count({c}) AS n, count(*) FILTER ({c} < created_datetime) AS negative, quantile_cont(h, 0.5) AS q50_hours, quantile_cont(h, 0.9) AS q90_hours FROM (SELECT *, (epoch_us({c}) - epoch_us(created_datetime)) / {d(3.6e9)} AS h FROM t_viol) WHERE {c} IS NOT NULL"
    for k, c in _DELAY.items()), ["q50_hours", "q90_hours"])
def workflow_latency(spark, folder):
    return profile.latency(T.facts(spark, folder), _DELAY)


_SEV = "CASE WHEN violation_type LIKE '%DOUBLE PARKING%' THEN 1.4 WHEN violation_type LIKE '%ROAD CROSSING%' THEN 1.35 WHEN violation_type LIKE '%MAIN ROAD%' THEN 1.3 WHEN violation_type LIKE '%FOOTPATH%' THEN 1.15 ELSE 1.0 END"
define("t_veh", f"""
SELECT zone_id, time_bucket, vehicle_number, count(*) AS n, sum(CAST({_SEV} AS DOUBLE)) AS sev, sum(greatest(named, is_main)) AS exposed, sum({case_map(_vehicle, V.PROXY_WEIGHT, V.DEFAULT_PROXY_WEIGHT)}) AS w,
  count(*) FILTER (validation_status = 'approved') AS ok, count(validation_status) AS known FROM t_prep GROUP BY zone_id, time_bucket, vehicle_number""")
define("t_proxy", f"""
SELECT *, {d(0.3)} * n / max(n) OVER () + {d(0.2)} * sev / max(sev) OVER () + {d(0.15)} * exposure + {d(0.1)} * repeats + {d(0.1)} * heavy
  + {d(0.1)} * CASE time_bucket WHEN 'morning_peak' THEN {d(1.0)} WHEN 'midday' THEN {d(0.8)} WHEN 'afternoon' THEN {d(0.6)} ELSE {d(0.3)} END + {d(0.05)} * confidence AS risk_raw
FROM (SELECT zone_id, time_bucket, CAST(sum(n) AS BIGINT) AS n, sum(sev) AS sev, sum(exposed) / sum(n) AS exposure, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS repeats, sum(w) / sum(n) / 1.5 AS heavy,
    CASE WHEN sum(known) > 0 THEN sum(ok) / sum(known) ELSE 0 END AS confidence FROM t_veh GROUP BY zone_id, time_bucket)""")


@query("proxy_risk_index", f"""
SELECT zone_id, time_bucket, risk_raw, risk_index, CASE WHEN risk_index <= 30 THEN 'Low' WHEN risk_index <= 60 THEN 'Medium' WHEN risk_index <= 80 THEN 'High' ELSE 'Critical' END AS band
FROM (SELECT *, (risk_raw - min(risk_raw) OVER ()) / (max(risk_raw) OVER () - min(risk_raw) OVER ()) * {d(100.0)} AS risk_index FROM t_proxy)""", ["risk_raw", "risk_index"])
def proxy_risk_index(spark, folder):
    return profile.proxy_index(zones.prepare(T.facts(spark, folder))).select("zone_id", "time_bucket", "risk_raw", "risk_index", "band")


@query("zone_features", f"""
SELECT z.*, s.station, row_number() OVER (PARTITION BY s.station ORDER BY z.total_records DESC, z.zone_id) AS rank_in_station FROM (
  SELECT zone_id, CAST(sum(n) AS BIGINT) AS total_records, sum(sev) AS severity_sum, max(sevmax) AS severity_max, count(device_id) AS device_count, max(n) / CAST(sum(n) AS DOUBLE) AS top_device_share,
    sum(ok) / CAST(sum(known) AS DOUBLE) AS approval_rate, sum(known) / CAST(sum(n) AS DOUBLE) AS validation_coverage, date_diff('day', CAST(max(last) AS DATE), (SELECT CAST(max(local_ts) AS DATE) FROM t_prep)) AS days_since_last
  FROM (SELECT zone_id, device_id, count(*) AS n, sum(CAST({_SEV} AS DOUBLE)) AS sev, max(CAST({_SEV} AS DOUBLE)) AS sevmax, max(local_ts) AS last, count(*) FILTER (validation_status = 'approved') AS ok, count(validation_status) AS known
    FROM t_prep GROUP BY zone_id, device_id) GROUP BY zone_id) z
JOIN t_station s ON s.zone_id = z.zone_id AND s.time_bucket = 'all_day'""", ["severity_sum", "severity_max", "top_device_share", "approval_rate", "validation_coverage"])
def zone_features(spark, folder):
    return profile.zone_features(zones.prepare(T.facts(spark, folder)))
