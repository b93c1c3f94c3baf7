"""Ridge model of traffic degradation from zone components, fitted from one aggregate of moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import bounded, dbl, degradation, ratio, valid_ratio
from kerbflow.session import ship

FEATURES = [*V.ROAD_COMPONENTS, "poi_count", "free_flow_speed_kmph"]
MIN_ROWS = 5  # fixed value: fewer measured zones give the default


def feature_table(scored: DataFrame, observed: DataFrame, context: DataFrame, bucket: str = V.ALL_DAY) -> DataFrame:
    """One row per zone of the bucket: six features, the label where measured, and what minutes_saved needs."""
    zones = scored.where(F.col("time_bucket") == bucket).select("zone_id", *V.ROAD_COMPONENTS, "congestion_impact")
    extra = observed.select("zone_id", "congestion_ratio", "free_flow_speed_kmph", "free_flow_s").join(
        context.select("zone_id", F.size("pois").cast("double").alias("poi_count")), "zone_id", "left")
    measured = valid_ratio(F.col("congestion_ratio"))
    joined = zones.join(extra, "zone_id", "left")
    return joined.select(
        "zone_id", *V.ROAD_COMPONENTS, *[F.when(measured, F.col(c)).alias(c) for c in ("poi_count", "free_flow_speed_kmph")],
        F.when(measured, degradation(F.col("congestion_ratio"))).alias("label"),
        F.when(measured, F.col("congestion_ratio")).alias("congestion_ratio"), "free_flow_s", "congestion_impact")


@dataclass
class Moments:
    """Sums over the measured rows; missing features count as zero value and zero presence."""

    n: float
    y: float
    zz: np.ndarray
    zo: np.ndarray
    oo: np.ndarray
    zy: np.ndarray
    oy: np.ndarray


def moments(table: DataFrame) -> Moments:
    """All sums in one aggregate; a fixed number of scalars reaches the driver."""
    rows = table.where(F.col("label").isNotNull())
    size = len(FEATURES)
    value = [F.coalesce(F.col(name), dbl(0.0)) for name in FEATURES]
    here = [F.col(name).isNotNull().cast("double") for name in FEATURES]
    sums: list[Column] = [F.count("*").cast("double"), F.sum("label")]
    sums += [F.sum(value[i] * value[j]) for i in range(size) for j in range(size)]
    sums += [F.sum(value[i] * here[j]) for i in range(size) for j in range(size)]
    sums += [F.sum(here[i] * here[j]) for i in range(size) for j in range(size)]
    sums += [F.sum(v * F.col("label")) for v in value] + [F.sum(h * F.col("label")) for h in here]
    row = rows.agg(*[column.alias(f"s{k}") for k, column in enumerate(sums)]).first()
    flat = np.array([0.0 if v is None else float(v) for v in row])
    square = size * size
    blocks = [flat[2 + k * square: 2 + (k + 1) * square].reshape(size, size) for k in range(3)]
    tail = flat[2 + 3 * square:]
    return Moments(flat[0], flat[1], *blocks, tail[:size], tail[size:])


def solve(n, y, zz, zo, oo, zy, oy, alpha: float):
    """Means, scales, slopes and intercept from sums; leading axes are independent problems.

    Mean imputation leaves a missing entry at zero after centring, so centred products need only the
    pairwise presence sums.
    """
    have = np.diagonal(oo, axis1=-2, axis2=-1)
    total = np.diagonal(zo, axis1=-2, axis2=-1)
    mean = np.where(have > 0, total / np.where(have > 0, have, 1.0), 0.0)
    left, right = mean[..., :, None], mean[..., None, :]
    centred = zz - zo * right - np.swapaxes(zo, -1, -2) * left + oo * left * right
    label_mean = y / n
    cross = zy - oy * mean - (total - have * mean) * np.asarray(label_mean)[..., None]
    spread = np.sqrt(np.maximum(np.diagonal(centred, axis1=-2, axis2=-1), 0.0) / np.asarray(n)[..., None])
    scale = np.where(spread > 1e-12, spread, 1.0)
    system = centred / (scale[..., :, None] * scale[..., None, :]) + alpha * np.eye(len(FEATURES))
    slope = np.linalg.solve(system, (cross / scale)[..., None])[..., 0]
    return mean, scale, slope, label_mean


def prediction(model) -> Column:
    """Fitted model as plain column arithmetic; a missing feature adds nothing."""
    mean, scale, slope, base = model
    value = dbl(float(base))
    for k, name in enumerate(FEATURES):
        term = (F.col(name) - dbl(mean[k])) * dbl(slope[k] / scale[k])
        value = value + F.coalesce(term, dbl(0.0))
    return value


def fit(table: DataFrame, alpha: float = 1.0):
    """Model over all measured zones, or None with fewer than five."""
    m = moments(table)
    if m.n < MIN_ROWS:
        return None
    return solve(m.n, m.y, m.zz, m.zo, m.oo, m.zy, m.oy, alpha)


def predictions(table: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Degradation of every zone: the label where measured, else the clamped prediction or the default."""
    model = fit(table, alpha)
    if model is None:
        guess, source = dbl(V.DEFAULT_DEGRADATION), "default_fallback"
    else:
        guess, source = bounded(prediction(model)), "predicted"
    measured = F.col("label").isNotNull()
    return table.select("zone_id", F.when(measured, F.col("label")).otherwise(guess).alias("degradation"),
                        F.when(measured, "measured").otherwise(source).alias("source"))


def leave_one_out(table: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Prediction of each measured zone by a model that never saw it.

    The sums without a row are the total sums minus the row's own, so each task solves its rows'
    small systems from the shared totals; no fold reads the table again.
    """
    m = moments(table)
    rows = table.where(F.col("label").isNotNull()).select("zone_id", "label", *FEATURES)
    if m.n < MIN_ROWS:
        return rows.select("zone_id", "label", F.lit(None).cast("double").alias("predicted"))

    ship(table.sparkSession)

    def solve_batch(batches):
        for batch in batches:
            x = batch[FEATURES].to_numpy(dtype=float)
            y = batch["label"].to_numpy(dtype=float)
            o = (~np.isnan(x)).astype(float)
            z = np.where(o > 0, x, 0.0)
            mean, scale, slope, base = solve(
                np.full(len(y), m.n - 1), m.y - y, m.zz - z[:, :, None] * z[:, None, :], m.zo - z[:, :, None] * o[:, None, :],
                m.oo - o[:, :, None] * o[:, None, :], m.zy - z * y[:, None], m.oy - o * y[:, None], alpha)
            guess = base + np.sum(o * (z - mean) / scale * slope, axis=1)
            yield pd.DataFrame({"zone_id": batch["zone_id"], "label": y, "predicted": np.clip(guess, 0.0, 1.0)})

    return rows.mapInPandas(solve_batch, "zone_id string, label double, predicted double")


def minutes_saved(table: DataFrame, teams: int = 6, effect: float = 0.6, patrol_alpha: float = 1.5, alpha: float = 1.0) -> DataFrame:
    """Minutes of measured delay relieved when patrols lower the three reducible components."""
    model = fit(table, alpha)
    zones = table.where(F.col("label").isNotNull() & (F.col("free_flow_s") > 0))
    if model is None:
        return zones.agg(F.count("*").alias("n_zones")).withColumns({
            name: F.lit(None).cast("double") for name in ("delay_min", "saved_min", "pct_of_delay")})
    weight = F.pow(F.greatest("congestion_impact", dbl(0.0)), dbl(patrol_alpha))
    p = ratio(weight, zones.agg(F.sum(weight)).scalar())
    cover = dbl(1.0) - F.pow(dbl(1.0) - p, dbl(float(teams)))
    before = zones.withColumns({"guess_before": prediction(model), "keep": dbl(1.0) - dbl(effect) * cover})
    lowered = ["lane_blockage", "intersection_impact", "access_blockage"]
    after = before.withColumns({name: F.col(name) * F.col("keep") for name in lowered}).withColumn("guess_after", prediction(model))
    excess = F.greatest(dbl(0.0), F.col("congestion_ratio") - 1.0)
    drop = dbl(2.0) * F.greatest(dbl(0.0), F.col("guess_before") - F.col("guess_after"))
    sums = after.agg(F.count("*").alias("n_zones"), F.sum(F.col("free_flow_s") * excess / 60.0).alias("delay_min"),
                     F.sum(F.col("free_flow_s") * F.least(drop, excess) / 60.0).alias("saved_min"))
    return sums.withColumn("pct_of_delay", ratio(F.col("saved_min"), F.col("delay_min")) * dbl(100.0))
