"""Validation, calibration search, degradation model, calibrated rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import degradation, half_up, split_of
from kerbflow.operators import blocked, calibrate, degrade, scoring, serving, stats
from kerbflow.plans import tables as T
from kerbflow.plans.catalog import query
from kerbflow.plans.oracle import band, clamp, d, define, digest_mod, rounded, weighted
from kerbflow.plans.serving_queries import observations, observed, scored
from kerbflow.session import materialise

_HONEST = weighted(calibrate.honest_weights())
_C4 = ", ".join(V.ROAD_COMPONENTS)
define("t_points", f"""
SELECT z.zone_id, {rounded('z.congestion_impact', 4)} AS impact, z.total_records AS count, {rounded(_HONEST, 6)} AS honest,
  {rounded('o.congestion_ratio', 4)} AS measured_ratio, c.is_exploration,
  CASE WHEN {digest_mod("'1337:' || z.zone_id", 100)} < 70 THEN 'train' ELSE 'test' END AS split, {_C4}
FROM t_day z JOIN t_obs o ON o.zone_id = z.zone_id JOIN t_context c ON c.zone_id = z.zone_id WHERE o.congestion_ratio > 0""")
define("t_pairs", """
SELECT 'impact_all' AS metric, zone_id, impact AS x, measured_ratio AS y FROM t_points
UNION ALL SELECT 'impact_test', zone_id, impact, measured_ratio FROM t_points WHERE split = 'test'
UNION ALL SELECT 'impact_exploration', zone_id, impact, measured_ratio FROM t_points WHERE is_exploration = 1
UNION ALL SELECT 'count_test', zone_id, CAST(count AS DOUBLE), measured_ratio FROM t_points WHERE split = 'test'
UNION ALL SELECT 'honest_test', zone_id, honest, measured_ratio FROM t_points WHERE split = 'test'""")


def _ranks(source: str, part: str) -> str:
    return f"""SELECT *, rank() OVER (PARTITION BY {part} ORDER BY x) + (count(*) OVER (PARTITION BY {part}, x) - 1) / {d(2.0)} AS rx,
  rank() OVER (PARTITION BY {part} ORDER BY y) + (count(*) OVER (PARTITION BY {part}, y) - 1) / {d(2.0)} AS ry FROM {source}"""


define("t_rho", f"""
SELECT metric, count(*) AS n, CASE WHEN count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rho
FROM ({_ranks('t_pairs', 'metric')}) GROUP BY metric""")


def point_table(spark, folder):
    table = scored(spark, folder)
    seen = observed(spark, folder).join(observations(spark, folder).select("zone_id", "is_exploration"), "zone_id")
    return materialise(calibrate.points(table, seen), "points"), table


@query("zone_splits", f"SELECT DISTINCT zone_id, CASE WHEN {digest_mod(chr(39) + '1337:' + chr(39) + ' || zone_id', 100)} < 70 THEN 'train' ELSE 'test' END AS split FROM t_placed")
def zone_splits(spark, folder):
    from kerbflow.operators import zones

    placed = T.zone_places(spark, folder).select("zone_id")
    return placed.select("zone_id", split_of("zone_id", V.SPLIT_SEED).alias("split"))


@query("validation_points", "SELECT zone_id, impact, count, honest, measured_ratio, is_exploration, split FROM t_points", {"impact": 4, "honest": 6, "measured_ratio": 4})
def validation_points(spark, folder):
    return point_table(spark, folder)[0].drop(*V.ROAD_COMPONENTS)


@query("spearman_metrics", "SELECT * FROM t_rho", ["rho"])
def spearman_metrics(spark, folder):
    return stats.spearman(calibrate.metric_pairs(point_table(spark, folder)[0]), ["metric"])


@query("pearson_metrics", "SELECT metric, count(*) AS n, CASE WHEN count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS r FROM t_pairs GROUP BY metric", ["r"])
def pearson_metrics(spark, folder):
    return stats.pearson(calibrate.metric_pairs(point_table(spark, folder)[0]), ["metric"])


_START = f"(slot * {blocked.MIX[0]} + 1 + boot * {blocked.MIX[1]} + {V.BOOTSTRAP_SEED * blocked.MIX[3]}) % {blocked.PRIME}"
_POWER = lambda x, step: f"((({x} * {x}) % {blocked.PRIME}) * (({x} * {x}) % {blocked.PRIME}) % {blocked.PRIME} * {x} + {step} * (boot + 1)) % {blocked.PRIME}"
_DEFINED = "CASE WHEN count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END"


def _intervals(name: str, pairs: str) -> None:
    """Define ``name``: metric, n, rho, lo, hi, p_approx of the (metric, zone_id, x, y) table ``pairs``."""
    define(f"{name}_slot", f"SELECT *, row_number() OVER (PARTITION BY metric ORDER BY zone_id) - 1 AS slot, count(*) OVER (PARTITION BY metric) AS size FROM {pairs}")
    define(f"{name}_draw", f"""
SELECT a.metric, a.boot, b.x, b.y, a.metric || ':' || a.boot AS g FROM (
  SELECT metric, boot, ({_POWER('s1', 2)}) % size AS pick FROM (SELECT metric, boot, size, {_POWER('s0', 1)} AS s1 FROM (
    SELECT metric, boot, size, {_START} AS s0 FROM {name}_slot, (SELECT unnest(range(0, 2000)) AS boot)))) a
JOIN {name}_slot b ON b.metric = a.metric AND b.slot = a.pick""")
    define(f"{name}_boot", f"""
SELECT metric, boot, round(rho, 9) AS rho FROM (SELECT metric, boot, {_DEFINED} AS rho FROM ({_ranks(f'{name}_draw', 'g')}) GROUP BY metric, boot) WHERE rho IS NOT NULL""")
    define(name, f"""
SELECT r.metric, r.n, r.rho, c.lo, c.hi, c.p_approx FROM (SELECT metric, count(*) AS n, {_DEFINED} AS rho FROM ({_ranks(pairs, 'metric')}) GROUP BY metric) r LEFT JOIN (
  SELECT metric, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi,
    least(1.0, 2.0 * least(avg(CASE WHEN rho <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN rho >= 0 THEN 1.0 ELSE 0.0 END))) AS p_approx
  FROM {name}_boot GROUP BY metric HAVING count(*) >= 200) c ON c.metric = r.metric""")


_intervals("t_ci", "t_pairs")


@query("bootstrap_intervals", "SELECT * FROM t_ci", {"rho": 6, "lo": 5, "hi": 5, "p_approx": 4})
def bootstrap_intervals(spark, folder):
    return stats.bootstrap(calibrate.metric_pairs(point_table(spark, folder)[0]), "metric", "zone_id")


@query("validation_report", """
SELECT c.*, CASE WHEN h.rho > k.rho THEN 1 ELSE 0 END AS baseline_beaten,
  CASE WHEN h.n < 5 OR h.rho IS NULL OR h.lo IS NULL THEN 'aborted' WHEN h.lo > coalesce(k.rho, 0) AND h.rho > 0.3 THEN 'strong' ELSE 'weak' END AS strength
FROM t_ci c, (SELECT * FROM t_ci WHERE metric = 'honest_test') h, (SELECT * FROM t_ci WHERE metric = 'count_test') k""", {"rho": 6, "lo": 5, "hi": 5, "p_approx": 4})
def validation_report(spark, folder):
    return calibrate.report(point_table(spark, folder)[0])


@query("ratio_variance_check", "SELECT count(measured_ratio) AS n, stddev_pop(measured_ratio) AS std, CASE WHEN count(measured_ratio) = 0 OR stddev_pop(measured_ratio) < 0.02 THEN 'aborted_flat_variance' ELSE 'ok' END AS status FROM t_points", ["std"])
def ratio_variance_check(spark, folder):
    return stats.flat_variance(point_table(spark, folder)[0], "measured_ratio")


def _u(i: int) -> str:
    return f"('0x' || substr(md5('{V.SEARCH_SEED}:' || candidate), {1 + 8 * i}, 8))::BIGINT"


_CUR = calibrate.honest_weights()
_GAPS = ["lo", "mid - lo", "hi - mid", "4294967296 - hi"]
define("t_cand", "SELECT candidate, " + ", ".join(
    f"CASE WHEN candidate = {i} THEN {d(1.0)} WHEN candidate < 4 THEN {d(0.0)} WHEN candidate = 4 THEN {d(_CUR[name])} ELSE CAST({_GAPS[i]} AS DOUBLE) / {d(4294967296.0)} END AS w{i}"
    for i, name in enumerate(V.ROAD_COMPONENTS)) + f"""
FROM (SELECT candidate, least(u1, u2, u3) AS lo, greatest(u1, u2, u3) AS hi, u1 + u2 + u3 - least(u1, u2, u3) - greatest(u1, u2, u3) AS mid
  FROM (SELECT candidate, {_u(0)} AS u1, {_u(1)} AS u2, {_u(2)} AS u3 FROM (SELECT CAST(unnest(range(0, 20005)) AS INTEGER) AS candidate)))""")
_PRED = " + ".join(f"w{i} * {name}" for i, name in enumerate(V.ROAD_COMPONENTS))
define("t_search", f"""
SELECT candidate, {rounded('rho', 9)} AS rho FROM (
  SELECT candidate, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rho FROM (
    {_ranks(f"(SELECT candidate, {rounded(_PRED, 9)} AS x, measured_ratio AS y FROM t_points, t_cand WHERE split = 'train')", 'candidate')}) GROUP BY candidate)""")
define("t_fit", """
SELECT c.candidate, s.rho AS train_rho, w0 AS lane_blockage, w1 AS intersection_impact, w2 AS access_blockage, w3 AS vehicle_size
FROM t_cand c JOIN (SELECT candidate, rho FROM t_search WHERE rho IS NOT NULL ORDER BY rho DESC, candidate LIMIT 1) s ON s.candidate = c.candidate""")


@query("weight_search", "SELECT * FROM t_fit", ["train_rho", *V.ROAD_COMPONENTS])
def weight_search(spark, folder):
    return calibrate.best_candidate(calibrate.search_weights(point_table(spark, folder)[0]))


@query("calibrated_weights", f"SELECT lane_blockage * {d(0.75)} AS lane_blockage, intersection_impact * {d(0.75)} AS intersection_impact, {d(0.25)} AS traffic_degradation, access_blockage * {d(0.75)} AS access_blockage, vehicle_size * {d(0.75)} AS vehicle_size FROM t_fit",
       list(V.IMPACT_WEIGHTS))
def calibrated_weights(spark, folder):
    full = calibrate.assemble(calibrate.fit(point_table(spark, folder)[0])[0])
    return spark.range(1).select(*[F.lit(value).alias(name) for name, value in full.items()])


define("t_calpairs", f"""
SELECT 'old_' || split AS metric, zone_id, {rounded(_HONEST, 9)} AS x, measured_ratio AS y FROM t_points
UNION ALL SELECT 'new_' || p.split, zone_id, {rounded(' + '.join(f'f.{c} * p.{c}' for c in V.ROAD_COMPONENTS), 9)}, measured_ratio FROM t_points p, t_fit f""")
_intervals("t_calci", "t_calpairs")
_SIDE = lambda column, metric: f"(SELECT {column} FROM t_calci WHERE metric = '{metric}')"
_STRENGTH = (f"CASE WHEN {_SIDE('n', 'new_test')} < 5 OR {_SIDE('rho', 'new_test')} IS NULL OR {_SIDE('lo', 'new_test')} IS NULL THEN 'aborted' "
             f"WHEN {_SIDE('lo', 'new_test')} > coalesce({_SIDE('rho', 'old_test')}, 0) AND {_SIDE('rho', 'new_test')} > 0.3 THEN 'strong' ELSE 'weak' END")


@query("calibration_report", f"""
SELECT split_part(metric, '_', 2) AS split, split_part(metric, '_', 1) AS which, n, rho, lo, hi, 'simplex_random_search' AS method, 'ok' AS status, {_STRENGTH} AS strength,
  (SELECT count(*) FROM t_points WHERE split = 'train') AS n_train, (SELECT count(*) FROM t_points WHERE split = 'test') AS n_test,
  (SELECT stddev_pop(measured_ratio) FROM t_points) AS ratio_std FROM t_calci""", {"rho": 6, "lo": 5, "hi": 5, "ratio_std": 6})
def calibration_report(spark, folder):
    rows = point_table(spark, folder)[0]
    return calibrate.calibration_report(rows, *calibrate.fit(rows))


_RAW = clamp(f"(o.congestion_ratio - {d(1.0)}) / {d(2.0)}")
_OVER = f"(CASE WHEN o.congestion_ratio IS NOT NULL THEN {_RAW} END)"
_FITTED = {name: f"f.{name} * {d(0.75)}" for name in V.ROAD_COMPONENTS}
# The ridge model in SQL: sums of products, centred and scaled, solved by elimination one column a step.
_X = degrade.FEATURES
_N = range(len(_X))
define("t_deg", f"""
SELECT z.zone_id, {', '.join(f'z.{c}' for c in V.ROAD_COMPONENTS)}, CASE WHEN o.congestion_ratio > 0 THEN CAST(c.poi_count AS DOUBLE) END AS poi_count,
  CASE WHEN o.congestion_ratio > 0 THEN o.free_flow_speed_kmph END AS free_flow_speed_kmph, CASE WHEN o.congestion_ratio > 0 THEN {_RAW} END AS label,
  CASE WHEN o.congestion_ratio > 0 THEN o.congestion_ratio END AS congestion_ratio, o.free_flow_s, z.congestion_impact
FROM t_day z LEFT JOIN t_obs o ON o.zone_id = z.zone_id LEFT JOIN t_context c ON c.zone_id = z.zone_id""")
define("t_degx", "SELECT zone_id, label, " + ", ".join(f"coalesce({c}, 0) AS z{i}, CAST({c} IS NOT NULL AS DOUBLE) AS o{i}" for i, c in enumerate(_X)) + " FROM t_deg WHERE label IS NOT NULL")
_TERMS = {"n": "1", "y": "label", **{f"zz{i}{j}": f"z{i} * z{j}" for i in _N for j in _N}, **{f"zo{i}{j}": f"z{i} * o{j}" for i in _N for j in _N},
          **{f"oo{i}{j}": f"o{i} * o{j}" for i in _N for j in _N}, **{f"zy{i}": f"z{i} * label" for i in _N}, **{f"oy{i}": f"o{i} * label" for i in _N}}
define("t_degsum", "SELECT " + ", ".join(f"CAST(sum({term}) AS DOUBLE) AS {name}" for name, term in _TERMS.items()) + " FROM t_degx")
define("t_degout", "SELECT x.*, " + ", ".join(f"s.{name} - {term} AS {name}" for name, term in _TERMS.items()) + " FROM t_degx x, t_degsum s")


def _solved(source: str, alpha: float = 1.0) -> str:
    """``source`` with the model's means m, slopes on the raw scale b and intercept base."""
    sql = f"SELECT *, y / n AS base, {', '.join(f'CASE WHEN oo{i}{i} > 0 THEN zo{i}{i} / oo{i}{i} ELSE 0 END AS m{i}' for i in _N)} FROM {source}"
    sql = f"SELECT *, {', '.join(f'zz{i}{j} - zo{i}{j} * m{j} - zo{j}{i} * m{i} + oo{i}{j} * m{i} * m{j} AS c{i}{j}' for i in _N for j in _N)}, " + \
        ", ".join(f"zy{i} - oy{i} * m{i} - (zo{i}{i} - oo{i}{i} * m{i}) * base AS d{i}" for i in _N) + f" FROM ({sql})"
    sql = f"SELECT *, {', '.join(f'CASE WHEN sqrt(greatest(c{i}{i}, 0) / n) > 1e-12 THEN sqrt(greatest(c{i}{i}, 0) / n) ELSE 1 END AS s{i}' for i in _N)} FROM ({sql})"
    sql = "SELECT *, " + ", ".join(f"c{i}{j} / (s{i} * s{j}) + {alpha if i == j else 0.0} AS a0_{i}{j}" for i in _N for j in _N) + \
        ", " + ", ".join(f"d{i} / s{i} AS r0_{i}" for i in _N) + f" FROM ({sql})"
    for k in _N:  # below row k the k-th column becomes zero
        rest = range(k + 1, len(_X))
        step = [f"a{k}_{i}{j} - a{k}_{i}{k} / a{k}_{k}{k} * a{k}_{k}{j} AS a{k + 1}_{i}{j}" for i in rest for j in rest]
        step += [f"r{k}_{i} - a{k}_{i}{k} / a{k}_{k}{k} * r{k}_{k} AS r{k + 1}_{i}" for i in rest]
        sql = f"SELECT *, {', '.join(step)} FROM ({sql})" if step else sql
    for k in reversed(_N):
        known = "".join(f" - a{k}_{k}{j} * w{j}" for j in range(k + 1, len(_X)))
        sql = f"SELECT *, (r{k}_{k}{known}) / a{k}_{k}{k} AS w{k} FROM ({sql})"
    return f"SELECT *, {', '.join(f'w{i} / s{i} AS b{i}' for i in _N)} FROM ({sql})"


_GUESS = lambda value: "base + " + " + ".join(f"coalesce(({value(i, c)} - m{i}) * b{i}, 0)" for i, c in enumerate(_X))
define("t_degfit", f"SELECT n, base, {', '.join(f'm{i}, b{i}' for i in _N)} FROM ({_solved('t_degsum')})")
define("t_degall", f"""
SELECT zone_id, coalesce(label, CASE WHEN n < 5 THEN {d(V.DEFAULT_DEGRADATION)} ELSE {clamp(_GUESS(lambda i, c: c))} END) AS degradation,
  CASE WHEN label IS NOT NULL THEN 'measured' WHEN n < 5 THEN 'default_fallback' ELSE 'predicted' END AS source FROM t_deg, t_degfit""")
define("t_degloo", f"SELECT zone_id, label, {clamp('base + ' + ' + '.join(f'o{i} * (z{i} - m{i}) * b{i}' for i in _N))} AS predicted FROM ({_solved('t_degout')})")
define("t_degrank", "SELECT predicted AS x, label AS y, 1 AS g FROM t_degloo")
_DELAY = ("lane_blockage", "intersection_impact", "access_blockage")
define("t_degcut", f"""
SELECT free_flow_s, greatest(0, congestion_ratio - 1) AS excess, {_GUESS(lambda i, c: c)} AS g0, {_GUESS(lambda i, c: f'{c} * keep' if c in _DELAY else c)} AS g1
FROM (SELECT *, 1 - 0.6 * (1 - pow(1 - pow(greatest(congestion_impact, 0), 1.5) / sum(pow(greatest(congestion_impact, 0), 1.5)) OVER (), 6)) AS keep FROM t_deg WHERE label IS NOT NULL AND free_flow_s > 0), t_degfit""")

define("t_rebuilt", f"""
SELECT z.zone_id, z.time_bucket, coalesce(o.degradation, z.traffic_degradation) AS traffic_degradation, CASE WHEN o.degradation IS NOT NULL THEN 0 ELSE z.is_defaulted END AS is_defaulted,
  greatest({d(0.0)}, least({d(100.0)}, {d(100.0)} * ({' + '.join(f'{w} * z.{n}' for n, w in _FITTED.items())} + {d(0.25)} * coalesce(o.degradation, z.traffic_degradation)))) AS congestion_impact
FROM t_comp z LEFT JOIN t_degall o ON o.zone_id = z.zone_id, t_fit f""")


def rebuilt(spark, folder, fitted=None):
    """Every zone and bucket under the fitted weights and its measured or predicted degradation."""
    rows, _ = point_table(spark, folder)
    weights = calibrate.assemble((fitted or calibrate.fit(rows))[0])
    labels = degrade.predictions(degradation_features(spark, folder)).select("zone_id", "degradation")
    return scoring.score(T.stored_zone_table(spark, folder), weights, labels)


@query("calibrated_rebuild", f"SELECT *, {band(rounded('congestion_impact', 9))} AS impact_band FROM t_rebuilt", {"traffic_degradation": 6, "congestion_impact": 5})
def calibrated_rebuild(spark, folder):
    return rebuilt(spark, folder).select("zone_id", "time_bucket", "traffic_degradation", "is_defaulted", "congestion_impact", "impact_band")


define("t_oldtop", "SELECT zone_id, row_number() OVER (ORDER BY round(congestion_impact, 6) DESC, zone_id) AS old_place FROM t_day QUALIFY old_place <= 50")
define("t_newtop", "SELECT zone_id, row_number() OVER (ORDER BY round(congestion_impact, 6) DESC, zone_id) AS new_place FROM t_rebuilt WHERE time_bucket = 'all_day' QUALIFY new_place <= 50")


@query("top_zone_difference", """
SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, old_place, new_place, CASE WHEN old_place IS NULL THEN 'added' WHEN new_place IS NULL THEN 'dropped' ELSE 'kept' END AS status,
  old_place - new_place AS delta FROM t_oldtop a FULL JOIN t_newtop b ON a.zone_id = b.zone_id""")
def top_zone_difference(spark, folder):
    first = T.impact_table(spark, folder).where("time_bucket = 'all_day'").select("zone_id", F.col("congestion_impact").alias("score"))
    second = rebuilt(spark, folder).where("time_bucket = 'all_day'").select("zone_id", F.col("congestion_impact").alias("score"))
    return serving.top_difference(first, second)


@query("measured_zones", f"SELECT z.zone_id, CASE WHEN o.congestion_ratio > 0 THEN 'measured' ELSE 'unmeasured' END AS kind, {_OVER} AS label FROM t_day z LEFT JOIN t_obs o ON o.zone_id = z.zone_id", ["label"])
def measured_zones(spark, folder):
    return degrade.feature_table(T.impact_table(spark, folder), observed(spark, folder), observations(spark, folder)).select(
        "zone_id", F.when(F.col("label").isNotNull(), "measured").otherwise("unmeasured").alias("kind"), "label")


def degradation_features(spark, folder):
    table = degrade.feature_table(T.impact_table(spark, folder), observed(spark, folder), observations(spark, folder))
    return materialise(table, "degradation-features")


@query("predicted_degradation", "SELECT * FROM t_degall", ["degradation"])
def predicted_degradation(spark, folder):
    return degrade.predictions(degradation_features(spark, folder))


@query("leave_one_zone_out", "SELECT * FROM t_degloo", ["label", "predicted"])
def leave_one_zone_out(spark, folder):
    return degrade.leave_one_out(degradation_features(spark, folder))


def held_out_quality(spark, folder):
    held = materialise(degrade.leave_one_out(degradation_features(spark, folder)), "held-out")
    rank = stats.spearman(held.select(F.lit("held_out").alias("g"), half_up(F.col("predicted"), 9).alias("x"), F.col("label").alias("y")), ["g"])
    fit = stats.errors(held, "label", "predicted").withColumn("g", F.lit("held_out")).drop("n")
    return rank.join(fit, "g").drop("g")


define("t_degquality", f"""
SELECT r.n, r.rho, e.mae, e.rmse, e.r2 FROM (SELECT count(*) AS n, {_DEFINED} AS rho FROM ({_ranks(f"(SELECT {rounded('x', 9)} AS x, y, g FROM t_degrank)", 'g')})) r,
  (SELECT avg(abs(predicted - label)) AS mae, sqrt(avg(pow(predicted - label, 2))) AS rmse, 1 - avg(pow(predicted - label, 2)) / var_pop(label) AS r2 FROM t_degloo) e""")


@query("degradation_quality", "SELECT * FROM t_degquality", {"rho": 5, "mae": 6, "rmse": 6, "r2": 6})
def degradation_quality(spark, folder):
    return held_out_quality(spark, folder)


@query("measured_minutes_saved", """
SELECT count(*) AS n_zones, sum(free_flow_s * excess / 60) AS delay_min, sum(free_flow_s * least(2 * greatest(0, g0 - g1), excess) / 60) AS saved_min,
  sum(free_flow_s * least(2 * greatest(0, g0 - g1), excess) / 60) / sum(free_flow_s * excess / 60) * 100 AS pct_of_delay FROM t_degcut""", {"delay_min": 4, "saved_min": 4, "pct_of_delay": 4})
def measured_minutes_saved(spark, folder):
    return degrade.minutes_saved(degradation_features(spark, folder), teams=6)


@query("calibration_metadata", f"""
SELECT 'v2' AS version, 'simplex_random_search' AS weights_method, {', '.join(f'{w} AS weight_{n}' for n, w in _FITTED.items())}, {d(0.25)} AS weight_traffic_degradation,
  {_SIDE('rho', 'old_test')} AS spearman_old_test, {_SIDE('rho', 'new_test')} AS spearman_test, (SELECT count(*) FROM t_points) AS n_measured,
  (SELECT count(*) FROM t_points WHERE is_exploration = 1) AS n_exploration, 'ridge' AS degradation_model, (SELECT r2 FROM t_degquality) AS degradation_lozo_r2,
  (SELECT rho FROM t_degquality) AS degradation_lozo_spearman FROM t_fit f""",
       {**{f"weight_{n}": 6 for n in V.IMPACT_WEIGHTS}, "spearman_old_test": 5, "spearman_test": 5, "degradation_lozo_r2": 6, "degradation_lozo_spearman": 5})
def calibration_metadata(spark, folder):
    """The one row that describes a calibrated rebuild."""
    rows = point_table(spark, folder)[0]
    weights, method = calibrate.fit(rows)
    held = held_out_quality(spark, folder)
    return calibrate.metadata(rows, weights, method, held)
