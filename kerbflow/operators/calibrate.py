"""Score calibration against measured ratios, observations from legs, weight search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.functions import geo as G
from kerbflow.functions import labels as L
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import bounded, dbl, moving_label, ratio, valid_ratio
from kerbflow.session import materialise


def calibrated_columns(raw: Column, actual: Column) -> dict[str, Column]:
    expected = dbl(1.0) + raw / dbl(100.0) * dbl(2.0)
    gap = actual - expected
    move = dbl(0.3) * (gap / F.greatest(expected, dbl(1.0)))
    status = F.when(move > 0.05, "adjusted_up").when(move < -0.05, "adjusted_down").otherwise("validated_accurate")
    return {"expected_ratio": expected, "discrepancy": gap, "adjustment": move,
            "calibrated_score": bounded(raw * (dbl(1.0) + move), 0.0, 100.0), "status": status}


def calibrate_all(scores: DataFrame) -> DataFrame:
    """Every zone of (zone_id, raw_score, travel_time_ratio); unmeasured ones keep their score."""
    has = F.coalesce(F.col("travel_time_ratio") != 0, F.lit(False))
    parts = calibrated_columns(F.col("raw_score"), F.col("travel_time_ratio"))
    rows = scores.withColumns({
        "expected_ratio": F.when(has, parts["expected_ratio"]), "discrepancy": F.when(has, parts["discrepancy"]),
        "adjustment": F.when(has, parts["adjustment"]).otherwise(dbl(0.0)),
        "calibrated_score": F.when(has, parts["calibrated_score"]).otherwise(F.col("raw_score")),
        "status": F.when(has, parts["status"]).otherwise("no_data"),
    })
    return rows.withColumn("impact_band", moving_label(F.col("calibrated_score")))


def calibrate_measured(scored: DataFrame, bucket: str = V.ALL_DAY, nudge: bool = True) -> DataFrame:
    """Only zones with a genuine measurement in the bucket. Without ``nudge`` the score stays as it is."""
    rows = scored.where((F.col("time_bucket") == bucket) & (F.col("is_defaulted") == 0)
                        & valid_ratio(F.col("travel_time_ratio")) & F.col("congestion_impact").isNotNull())
    parts = calibrated_columns(F.col("congestion_impact"), F.col("travel_time_ratio"))
    if not nudge:
        parts |= {"adjustment": dbl(0.0), "calibrated_score": F.col("congestion_impact"), "status": F.lit("report_only")}
    rows = rows.select("zone_id", F.coalesce("station", F.lit("Unknown PS")).alias("station"),
                       F.col("congestion_impact").alias("raw_score"), "travel_time_ratio",
                       *[part.alias(name) for name, part in parts.items()])
    return rows.withColumn("impact_band", moving_label(F.col("calibrated_score")))


def calibration_summary(records: DataFrame) -> DataFrame:
    size = F.when(F.col("status") != "no_data", F.abs("adjustment"))
    return records.agg(
        F.count("*").alias("total_zones"), F.count_if(F.col("status") != "no_data").alias("validated"),
        F.count_if(F.col("status") == "no_data").alias("no_data"),
        F.count_if(F.col("status") == "validated_accurate").alias("accurate"),
        F.count_if(F.col("status") == "adjusted_up").alias("adjusted_up"),
        F.count_if(F.col("status") == "adjusted_down").alias("adjusted_down"),
        F.coalesce(F.avg(size) * 100, dbl(0.0)).alias("mean_abs_adjustment_pct"),
        F.coalesce(F.max(size) * 100, dbl(0.0)).alias("max_abs_adjustment_pct"))


def calibration_log(records: DataFrame) -> DataFrame:
    text = L.calibration_story(F.col("status"), F.col("raw_score"), F.col("calibrated_score"), F.col("travel_time_ratio"),
                               F.col("expected_ratio"), F.col("zone_id"))
    return records.select("zone_id", "status", text.alias("reasoning"))


def leg_table(observations: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per leg with ratio, length (given or great-circle) and free-flow speed.

    ``centres`` has zone_id, lat, lon.
    """
    legs = observations.select("zone_id", F.explode("raw_legs").alias("leg")).select("zone_id", "leg.*")
    ends = centres.select("zone_id", "lat", "lon", F.explode(G.leg_ends(F.col("lat"), F.col("lon"))).alias("end")).select(
        "zone_id", "lat", "lon", "end.*")
    met = legs.join(ends, ["zone_id", "direction"])
    length = G.haversine_m(F.col("lat"), F.col("lon"), F.col("end_lat"), F.col("end_lon"))
    timed = F.col("baseline_s") > 0
    chosen = F.coalesce("distance_m", length)
    return met.select(
        "zone_id", "direction", "baseline_s", "eta_s", length.alias("haversine_m"),
        F.when(timed & F.col("eta_s").isNotNull(), F.round(ratio(F.col("eta_s"), F.col("baseline_s"), None), 4)).alias("ratio"),
        F.when(timed & (chosen > 0), ratio(chosen, F.col("baseline_s"), None) * dbl(3.6)).alias("speed_kmph"),
        F.when(timed & F.col("distance_m").isNull(), 1).otherwise(0).alias("approx"))


def observe(legs: DataFrame) -> DataFrame:
    """Median ratio and free-flow speed per zone; four legs per zone, so groups stay tiny."""
    usable = F.when(valid_ratio(F.col("ratio")), F.col("ratio"))
    return legs.groupBy("zone_id").agg(
        F.median(usable).alias("congestion_ratio"), F.count(usable).alias("n_legs"),
        F.median("speed_kmph").alias("free_flow_speed_kmph"), F.max("approx").alias("free_flow_speed_approx"),
        F.median(F.when(F.col("baseline_s") > 0, F.col("baseline_s"))).alias("free_flow_s"))


def honest_weights(weights: dict[str, float] = V.IMPACT_WEIGHTS) -> dict[str, float]:
    """Weights of the four road components, rescaled to one; equal when they sum to zero."""
    raw = {name: float(weights.get(name, 0.0)) for name in V.ROAD_COMPONENTS}
    total = sum(raw.values())
    return {name: value / total if total > 0 else 1 / len(raw) for name, value in raw.items()}


def points(scored: DataFrame, observed: DataFrame, bucket: str = V.ALL_DAY, seed: int = V.SPLIT_SEED,
           weights: dict[str, float] = V.IMPACT_WEIGHTS) -> DataFrame:
    """Zones with both a score and a valid measured ratio, with split and the non-circular score."""
    from kerbflow.functions.basics import half_up, split_of
    from kerbflow.operators.scoring import weighted_sum
    from kerbflow.operators.serving import at_bucket

    measured = observed.where(valid_ratio(F.col("congestion_ratio"))).select("zone_id", "congestion_ratio", "is_exploration")
    met = at_bucket(scored, bucket).join(measured, "zone_id")
    return met.select(
        "zone_id", half_up(F.col("congestion_impact"), 4).alias("impact"), F.col("total_records").alias("count"),
        half_up(weighted_sum(honest_weights(weights)), 6).alias("honest"), half_up(F.col("congestion_ratio"), 4).alias("measured_ratio"),
        "is_exploration", split_of("zone_id", seed).alias("split"), *V.ROAD_COMPONENTS)


def metric_pairs(rows: DataFrame) -> DataFrame:
    """Long table (metric, zone_id, x, y) of every correlation in the validation report."""
    test, explore = F.col("split") == "test", F.col("is_exploration") == 1
    choices = [(F.lit(True), "impact_all", "impact"), (test, "impact_test", "impact"), (explore, "impact_exploration", "impact"),
               (test, "count_test", "count"), (test, "honest_test", "honest")]
    items = F.array(*[F.when(where, F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("x")))
                      for where, name, column in choices])
    long = rows.select("zone_id", F.col("measured_ratio").alias("y"), F.explode(F.array_compact(items)).alias("item"))
    return long.select("item.metric", "zone_id", "item.x", "y")


def report(rows: DataFrame, n_boot: int = 2000) -> DataFrame:
    """One row per metric with interval, plus whether the honest score beats the raw count and how strongly."""
    from kerbflow.operators.stats import bootstrap, strength

    stored_rows = bootstrap(metric_pairs(rows), "metric", "zone_id", n_boot)
    wide = stored_rows.agg(
        F.max(F.when(F.col("metric") == "honest_test", F.col("rho"))).alias("honest_rho"),
        F.max(F.when(F.col("metric") == "honest_test", F.col("lo"))).alias("honest_lo"),
        F.max(F.when(F.col("metric") == "honest_test", F.col("n"))).alias("n_proof"),
        F.max(F.when(F.col("metric") == "count_test", F.col("rho"))).alias("count_rho"))
    verdict = wide.select(F.struct(
        F.when(F.col("honest_rho") > F.col("count_rho"), 1).otherwise(0).alias("baseline_beaten"),
        strength(F.col("n_proof"), F.col("honest_rho"), F.col("honest_lo"), F.col("count_rho")).alias("strength"))).scalar()
    return stored_rows.withColumns({"baseline_beaten": verdict.getField("baseline_beaten"), "strength": verdict.getField("strength")})


CHUNK = 64  # candidates ranked by a task at a time


def candidates(spark: SparkSession, n_samples: int, seed: int) -> DataFrame:
    """Search candidates: four corners, the current weights, then uniform simplex draws.

    A draw is the spacing of three sorted 32-bit numbers taken from one hash, so it is exact.
    """
    digest = spark.range(5 + n_samples).selectExpr("CAST(id AS INT) AS candidate", f"md5(concat('{seed}:', id)) AS h")
    drawn = digest.select("candidate", *[
        F.expr(f"CAST(conv(substr(h, {1 + 8 * i}, 8), 16, 10) AS BIGINT)").alias(f"u{i}") for i in range(3)])
    ends = drawn.selectExpr("candidate", "least(u0, u1, u2) AS low", "greatest(u0, u1, u2) AS high", "u0 + u1 + u2 AS total")
    gaps = ["low", "total - high - 2 * low", "2 * high - total + low", f"{2 ** 32} - high"]
    who, current = F.col("candidate"), honest_weights()
    return ends.select("candidate", *[
        F.when(who == i, dbl(1.0)).when(who < 4, dbl(0.0)).when(who == 4, dbl(current[name]))
        .otherwise(F.expr(f"CAST({gaps[i]} AS DOUBLE)") / dbl(float(2 ** 32))).alias(f"weight_{name}")
        for i, name in enumerate(V.ROAD_COMPONENTS)])


def search_weights(rows: DataFrame, n_samples: int = 20000, seed: int = V.SEARCH_SEED) -> DataFrame:
    """Rank correlation with the measured ratio of every candidate weighting of the train zones.

    Equal component vectors are one row with the sum of its label ranks; chunks of candidates are ranked inside
    tasks, block against block, and only the sums of a candidate leave them.
    """
    from kerbflow.functions.basics import half_up
    from kerbflow.operators.blocked import candidate_correlations
    from kerbflow.operators.ranking import average_rank

    train = rows.where(F.col("split") == "train").groupBy("measured_ratio", *V.ROAD_COMPONENTS).agg(F.count("*").alias("n"))
    train = materialise(train, "train-rows")
    ranks = average_rank(train.groupBy("measured_ratio").agg(F.sum("n").alias("n")), "measured_ratio", (), "n", "ry").drop("n")
    rank, n = F.col("ry"), F.col("n")
    vectors = train.join(ranks, "measured_ratio").groupBy(*V.ROAD_COMPONENTS).agg(
        F.sum("n").alias("n"), F.sum(n * rank).alias("label"), F.sum(n * rank * rank).alias("squares"))
    sums = candidate_correlations(vectors, candidates(rows.sparkSession, n_samples, seed), V.ROAD_COMPONENTS, CHUNK)
    product = F.col("xx") * F.col("yy")
    rho = F.when(product > 0, F.col("xy") / F.sqrt(F.when(product > 0, product)))
    return sums.select("candidate", half_up(rho, 9).alias("rho"))


def best_candidate(found: DataFrame, n_samples: int = 20000, seed: int = V.SEARCH_SEED) -> DataFrame:
    """Best candidate (lowest number on ties) with its four weights."""
    pick = found.where(F.col("rho").isNotNull()).agg(F.min(F.struct((-F.col("rho")).alias("minus"), "candidate")).alias("best"))
    row = pick.select(F.col("best.candidate").alias("candidate"), (-F.col("best.minus")).alias("train_rho"))
    pool = candidates(found.sparkSession, n_samples, seed)
    return row.join(pool, "candidate").select(
        "candidate", "train_rho", *[F.col(f"weight_{name}").alias(name) for name in V.ROAD_COMPONENTS])


def assemble(weights: dict[str, float]) -> dict[str, float]:
    """Five weights: the traffic weight keeps its value, the fitted four share the rest."""
    fixed = V.IMPACT_WEIGHTS["traffic_degradation"]
    scaled = {name: weights[name] * (1 - fixed) for name in V.ROAD_COMPONENTS}
    return {name: fixed if name == "traffic_degradation" else scaled[name] for name in V.IMPACT_WEIGHTS}


def fit(rows: DataFrame, n_samples: int = 20000) -> tuple[dict[str, float], str]:
    """Fitted four weights and the method used; too few or flat measurements keep the current weights."""
    from kerbflow.operators.stats import MIN_POINTS, flat_variance

    check = flat_variance(rows, "measured_ratio").first()
    if check["status"] != "ok":
        return honest_weights(), check["status"]
    if rows.where(F.col("split") == "train").count() < MIN_POINTS:
        return honest_weights(), "fallback_insufficient_data"
    row = best_candidate(search_weights(rows, n_samples), n_samples).first()
    if row is None:
        return honest_weights(), "fallback_insufficient_data"
    return {name: row[name] for name in V.ROAD_COMPONENTS}, "simplex_random_search"


def _old_and_new(rows: DataFrame, new: dict[str, float]) -> DataFrame:
    """(metric, zone_id, x, y): the old and the new four weights against the measured ratio, by split."""
    from kerbflow.functions.basics import half_up
    from kerbflow.operators.scoring import weighted_sum

    pair = F.array(
        F.struct(F.lit("old").alias("which"), half_up(weighted_sum(honest_weights()), 9).alias("x")),
        F.struct(F.lit("new").alias("which"), half_up(weighted_sum(new), 9).alias("x")))
    long = rows.select("zone_id", "split", F.col("measured_ratio").alias("y"), F.explode(pair).alias("p"))
    return long.select(F.concat_ws("_", "p.which", "split").alias("metric"), "zone_id", "p.x", "y")


def calibration_report(rows: DataFrame, new: dict[str, float], method: str, n_boot: int = 2000) -> DataFrame:
    """Spearman of the old and new weights by split with intervals, the counts, and how far the fit may be trusted.

    ``status`` is ``ok`` or why the weights were kept; a fit that was not made has strength ``aborted``.
    """
    from kerbflow.operators.stats import bootstrap, strength

    made = materialise(bootstrap(_old_and_new(rows, new), "metric", "zone_id", n_boot), "calibration-intervals")
    pick = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    sides = made.agg(pick("new_test", "n").alias("n"), pick("new_test", "rho").alias("rho"), pick("new_test", "lo").alias("lo"), pick("old_test", "rho").alias("old"))
    verdict = sides.select(strength(F.coalesce("n", F.lit(0)), F.col("rho"), F.col("lo"), F.col("old"))).scalar()
    counts = rows.agg(F.struct(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"),
                               F.stddev_pop("measured_ratio").alias("ratio_std"))).scalar()
    fitted = method == "simplex_random_search"
    parts = F.split("metric", "_")
    return made.select(
        parts[1].alias("split"), parts[0].alias("which"), "n", "rho", "lo", "hi", F.lit(method).alias("method"), F.lit("ok" if fitted else method).alias("status"),
        (verdict if fitted else F.lit("aborted")).alias("strength"), *[counts.getField(c).alias(c) for c in ("n_train", "n_test", "ratio_std")])


def metadata(rows: DataFrame, weights: dict[str, float], method: str, held_out: DataFrame) -> DataFrame:
    """One row that describes a calibrated rebuild; ``held_out`` has rho and r2 of the degradation model."""
    from kerbflow.operators.stats import spearman

    test = spearman(_old_and_new(rows.where(F.col("split") == "test"), weights), ["metric"])
    rho = test.groupBy().pivot("metric", ["old_test", "new_test"]).agg(F.max("rho"))
    counts = rows.agg(F.count("*").alias("n_measured"), F.count_if(F.col("is_exploration") == 1).alias("n_exploration"))
    value = lambda df, column: df.select(column).scalar()
    return rows.sparkSession.range(1).select(
        F.lit("v2").alias("version"), F.lit(method).alias("weights_method"), *[F.lit(w).alias(f"weight_{name}") for name, w in assemble(weights).items()],
        value(rho, "old_test").alias("spearman_old_test"), value(rho, "new_test").alias("spearman_test"),
        value(counts, "n_measured").alias("n_measured"), value(counts, "n_exploration").alias("n_exploration"), F.lit("ridge").alias("degradation_model"),
        value(held_out, "r2").alias("degradation_lozo_r2"), value(held_out, "rho").alias("degradation_lozo_spearman"))
