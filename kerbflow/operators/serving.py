"""Read queries over the scored zone table: rankings, layers, station views, allocation inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import labels as L
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl, ratio
from kerbflow.operators.ranking import position
from kerbflow.session import materialise

UNIVERSE = 60
RISK_ORDER = [("risk_score", False), ("zone_id", True)]


def best(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """First ``limit`` rows in order, with their position; a distributed top-k, so only ``limit`` rows are numbered."""
    return df.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def at_bucket(scored: DataFrame, bucket: str) -> DataFrame:
    """One row per zone: the wanted bucket, else the day rollup, else the first bucket by name."""
    choice = F.when(F.col("time_bucket") == bucket, 0).when(F.col("time_bucket") == V.ALL_DAY, 1).otherwise(2)
    row = F.struct(*scored.columns)
    picked = scored.groupBy("zone_id").agg(F.min_by(row, F.struct(choice, F.col("time_bucket"))).alias("row"))
    return picked.select("row.*")


def hotspots(scored: DataFrame, bucket: str = V.ALL_DAY, limit: int = 50) -> DataFrame:
    """Zones by descending impact."""
    rows = scored.where(F.col("time_bucket") == bucket) if bucket == V.ALL_DAY else at_bucket(scored, bucket)
    slim = rows.select(
        "zone_id", F.round("congestion_impact", 6).alias("congestion_impact"), "impact_band",
        F.col("total_records").alias("violation_count"), "station",
        F.get("top_violations", F.lit(0)).alias("top_violation"), "lane_hours")
    return best(slim, limit, F.col("congestion_impact").desc(), F.col("zone_id"))


def hour_bucket(hour: Column) -> Column:
    """Impact bucket of an hour; hours outside the data-rich window fall back to the day rollup."""
    from kerbflow.functions.events import hour_label

    return F.coalesce(hour_label(hour, V.IMPACT_BUCKETS), F.lit(V.ALL_DAY))


def universe(scored: DataFrame, traffic: DataFrame, calibrated: DataFrame, size: int | None = None) -> DataFrame:
    """Zones by volume with priority score, proxies and game quantities; all of them, or the top ``size``.

    ``traffic`` has zone_id, travel_time_ratio and road_name; ``calibrated`` has zone_id, calibrated_score and
    status. Positions come from range slices and sums are scalars, so no task holds all zones.
    """
    day = at_bucket(scored, V.ALL_DAY).drop("travel_time_ratio")
    if size is None:
        top = position(day, [("total_records", False), ("zone_id", True)])
    else:
        top = best(day, size, F.col("total_records").desc(), F.col("zone_id"))
    top = materialise(top, "universe-zones")
    whole = top.agg(F.count("*").alias("n"), F.max("total_records").alias("most")).select(F.struct("n", "most")).scalar()
    count, volume = whole.getField("n"), F.col("total_records")
    rows = (top.join(traffic.select("zone_id", "travel_time_ratio", "road_name"), "zone_id", "left")
            .join(calibrated.select("zone_id", "calibrated_score", F.col("status").alias("agent_status")), "zone_id", "left"))
    rows = rows.select(
        "zone_id", "lat", "lon", "station", "congestion_impact", "impact_band", "place", "travel_time_ratio", "agent_status",
        "top_violations", volume.alias("violation_count"), "lane_hours", "vehicle_size",
        F.coalesce("road_name", "station", "zone_id").alias("road_name"),
        F.coalesce("calibrated_score", "congestion_impact").alias("calibrated_score"),
        F.round(dbl(100.0) * (count - F.col("place") + 1).cast("double") / count, 1).alias("risk_score"),
        ratio(volume, whole.getField("most")).alias("density"))
    rows = rows.withColumns({
        "risk_label": L.served_label(F.col("risk_score")),
        "road_importance": L.road_importance(F.col("road_name"), F.col("travel_time_ratio")),
        "repeat_offender": dbl(0.3) + dbl(0.5) * F.col("density"),
        "heavy_vehicle_ratio": F.coalesce("vehicle_size", dbl(0.0)),
        "top_violation": F.get("top_violations", F.lit(0)),
    })
    rows = rows.withColumn("road_type", F.when(F.col("road_importance") > 0.8, "primary").otherwise("secondary"))
    weight = F.pow(F.greatest("risk_score", dbl(0.0)), dbl(1.5))
    rows = materialise(rows.withColumn("weight", weight), "universe-rows")
    sums = rows.agg(F.sum("weight").alias("w"), F.sum("risk_score").alias("r")).select(F.struct("w", "r")).scalar()
    rows = rows.withColumn("patrol_probability", ratio(F.col("weight"), sums.getField("w"))).drop("weight")
    p = F.col("patrol_probability")
    cost = p * dbl(500.0)
    net = (dbl(1.0) - p) * F.col("risk_score") - cost
    return rows.withColumns({
        "baseline_weight": ratio(F.col("risk_score"), sums.getField("r")), "expected_cost": cost,
        "net_benefit": net, "violator_risk_score": F.greatest(dbl(0.0), F.least(dbl(100.0), net)),
    })


def by_risk() -> list[Column]:
    return [F.col("risk_score").desc(), F.col("zone_id")]


def rescored(served: DataFrame, scored: DataFrame, bucket: str) -> DataFrame:
    """Served zones with the impact of one bucket (day rollup where it is missing); same zone set."""
    entry = at_bucket(scored, bucket).select(
        "zone_id", F.col("congestion_impact").alias("bucket_impact"), F.col("impact_band").alias("bucket_label"))
    joined = served.join(entry, "zone_id", "left")
    return joined.withColumns({
        "congestion_impact": F.coalesce("bucket_impact", "congestion_impact"),
        "impact_band": F.coalesce("bucket_label", "impact_band"),
    }).drop("bucket_impact", "bucket_label")


def top_zones(served: DataFrame, scored: DataFrame, limit: int, bucket: str = V.ALL_DAY) -> DataFrame:
    if bucket == V.ALL_DAY:
        return best(served.drop("place"), limit, *by_risk())
    rows = rescored(served, scored, bucket).withColumn("congestion_impact", F.round("congestion_impact", 6))
    return best(rows.drop("place"), limit, F.col("congestion_impact").desc(), F.col("zone_id"))


def impact_layer(scored: DataFrame, bucket: str) -> DataFrame:
    """Heat points, intensity = impact score."""
    return at_bucket(scored, bucket).select("zone_id", "lat", "lon", "impact_band", F.col("congestion_impact").alias("intensity"))


def density_layer(scored: DataFrame, bucket: str) -> DataFrame:
    """Heat points, intensity = number of records."""
    return at_bucket(scored, bucket).select(
        "zone_id", "lat", "lon", "impact_band", F.col("total_records").cast("double").alias("intensity"))


def served_layer(served: DataFrame, column: str) -> DataFrame:
    return served.select("zone_id", "lat", "lon", F.col(column).cast("double").alias("intensity"))


def intensity_range(layer: DataFrame) -> DataFrame:
    return layer.agg(F.count("*").alias("points"), F.coalesce(F.min("intensity"), dbl(0.0)).alias("min_intensity"),
                     F.coalesce(F.max("intensity"), dbl(0.0)).alias("max_intensity"))


def impact_probabilities(scored: DataFrame, bucket: str, alpha: float = 1.5) -> DataFrame:
    """Patrol probability of every zone proportional to impact^alpha; zero when all scores are zero."""
    rows = materialise(at_bucket(scored, bucket).select("zone_id", "congestion_impact"), "bucket-impact")
    weight = F.pow(F.greatest("congestion_impact", dbl(0.0)), dbl(alpha))
    total = rows.agg(F.sum(weight)).scalar()
    return rows.withColumn("patrol_probability", ratio(weight, total))


def stations(served: DataFrame) -> DataFrame:
    """Zones, violations and centre per station."""
    return served.groupBy(F.coalesce("station", F.lit("Unknown")).alias("station")).agg(
        F.count("*").alias("zone_count"), F.sum("violation_count").alias("total_violations"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def station_zones(served: DataFrame, station: str) -> DataFrame:
    return served.where(F.lower(F.coalesce("station", F.lit(""))) == station.lower())


def priority_areas(zones: DataFrame, limit: int = 10) -> DataFrame:
    """Zones of one station with force, distance from the station's centre and travel minutes."""
    from kerbflow.functions.geo import flat_km

    base = zones.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).select(F.struct("lat", "lon")).scalar()
    picked = best(zones.drop("place"), limit, *by_risk())
    km = F.round(flat_km(F.abs(F.col("lat") - base.getField("lat")), F.abs(F.col("lon") - base.getField("lon"))), 1)
    return picked.withColumns({
        "force_needed": L.force(F.col("risk_score")), "priority": L.priority(F.col("risk_score")), "distance_km": km,
    }).withColumn("eta_minutes", F.greatest(F.lit(3), F.bround(F.col("distance_km") * 4, 0).cast("int")))


def station_summary(served: DataFrame) -> DataFrame:
    """Per station: zones, violations, high-risk zones, zones per priority and total force."""
    score = F.col("risk_score")
    return served.groupBy("station").agg(
        F.count("*").alias("total_zones"), F.sum("violation_count").alias("total_violations"),
        F.count_if(score >= 67).alias("high_risk_zones"), F.count_if((score >= 34) & (score < 67)).alias("medium_zones"),
        F.count_if(score < 34).alias("low_zones"), F.sum(L.force(score)).alias("total_force"))


def label_breakdown(served: DataFrame, *keys: str) -> DataFrame:
    return served.groupBy(*keys, "risk_label").agg(
        F.count("*").alias("zone_count"), F.avg("risk_score").alias("avg_score"), F.min("risk_score").alias("min_score"),
        F.max("risk_score").alias("max_score"), F.sum("violation_count").alias("total_violations"))


def overview(served: DataFrame) -> DataFrame:
    """Label distribution next to the overall leader and zone count."""
    leader = served.agg(
        F.min(F.struct((-F.col("risk_score")).alias("minus"), "zone_id")).getField("zone_id").alias("top_zone"),
        F.count("*").alias("total_zones"))
    packed = leader.select(F.struct("top_zone", "total_zones")).scalar()
    return label_breakdown(served).select(
        "risk_label", "zone_count", "avg_score", "total_violations",
        packed.getField("top_zone").alias("top_zone"), packed.getField("total_zones").alias("total_zones"))


def patrol_overlay(served: DataFrame, limit: int = 50, least: float = 0.001) -> DataFrame:
    """First zones by priority, then those with a visible probability (the filter comes after the limit)."""
    return best(served.drop("place"), limit, *by_risk()).where(F.col("patrol_probability") > least).select(
        "zone_id", "lat", "lon", "patrol_probability", "risk_score")


def leaders(served: DataFrame, column: str, limit: int) -> DataFrame:
    """Zones with the highest value of a column, compared at 9 decimals."""
    rows = served.select("zone_id", F.round(column, 9).alias(column))
    return best(rows, limit, F.col(column).desc(), F.col("zone_id"))


def assigned(served: DataFrame, teams: int) -> DataFrame:
    """Zones split into covered (first ``teams`` by priority) and uncovered, each covered one with its team."""
    ranked = position(served.drop("place"), RISK_ORDER)
    covered = F.col("place") <= teams
    return ranked.withColumns({"covered": F.when(covered, 1).otherwise(0), "team": F.when(covered, F.col("place"))})


def assignments(served: DataFrame, teams: int) -> DataFrame:
    """One row per team: its zone and what it covers."""
    return assigned(served, teams).where("covered = 1").select("team", "zone_id", "station", "risk_score", "patrol_probability")


def allocation_report(served: DataFrame, teams: int) -> DataFrame:
    """Covered and total risk, and how many high-risk zones have no team."""
    marked = assigned(served, teams)
    covered, score = F.col("covered") == 1, F.col("risk_score")
    sums = marked.agg(
        F.count_if(covered).alias("num_teams"), F.sum(F.when(covered, score).otherwise(0.0)).alias("total_risk_covered"),
        F.sum(score).alias("total_risk"), F.count_if(~covered & (score >= 67)).alias("uncovered_high_risk"))
    return sums.select("num_teams", "total_risk_covered",
                       (ratio(F.col("total_risk_covered"), F.col("total_risk"), 0.0) * dbl(100.0)).alias("coverage_pct"), "uncovered_high_risk")


def uncovered_high(served: DataFrame, teams: int, limit: int | None = None) -> DataFrame:
    """High-risk zones without a team, all of them or the first ``limit`` by priority."""
    rows = assigned(served, teams).where((F.col("covered") == 0) & (F.col("risk_score") >= 67))
    rows = rows if limit is None else rows.orderBy("place").limit(limit)
    return rows.select("zone_id", "risk_score")


def coverage_curve(served: DataFrame, most: int = 10) -> DataFrame:
    """Coverage for 1..most teams from one running sum over the first ``most`` zones; the rest enters by totals."""
    zones = materialise(served.select("zone_id", "risk_score"), "curve-zones")
    high = F.when(F.col("risk_score") >= 67, 1).otherwise(0)
    whole = zones.agg(F.sum("risk_score").alias("risk"), F.sum(high).alias("high")).select(F.struct("risk", "high")).scalar()
    first = best(zones, most, *by_risk())
    upto = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # over ``most`` rows
    return first.select(
        F.col("place").alias("num_teams"), (ratio(F.sum("risk_score").over(upto), whole.getField("risk")) * dbl(100.0)).alias("coverage_pct"),
        (whole.getField("high") - F.sum(high).over(upto)).alias("uncovered_high_risk"))


def displaced_zones(served: DataFrame, teams: int = 5) -> DataFrame:
    """Each covered zone pushes part of its pressure to the nearest uncovered zone."""
    from kerbflow.operators.neighbours import nearest, zone_points

    marked = assigned(served, teams)
    covered, free = marked.where("covered = 1"), marked.where("covered = 0")
    pairs = nearest(zone_points(covered), zone_points(free), 1)
    pushed = pairs.join(covered.select(F.col("zone_id").alias("src"), "patrol_probability"), "src").groupBy(
        F.col("dst").alias("zone_id")).agg(F.sum(dbl(0.12) * F.col("patrol_probability")).alias("push"))
    share = F.least("push", dbl(0.25))
    return free.join(pushed, "zone_id").select(
        "zone_id", F.col("risk_score").alias("original_risk"), (F.col("risk_score") * (dbl(1.0) + share)).alias("adjusted_risk"),
        (share * dbl(100.0)).alias("risk_change_pct"))


def zone_arrows(served: DataFrame, top: int = 5) -> DataFrame:
    """From each leading zone to its nearest other zone."""
    from kerbflow.operators.neighbours import nearest, zone_points

    first = best(served.drop("place"), top, *by_risk())
    pairs = nearest(zone_points(first), zone_points(served), 1)
    return pairs.join(first.select(F.col("zone_id").alias("src"), "patrol_probability"), "src").select(
        F.col("src").alias("from_zone"), F.col("dst").alias("to_zone"), F.col("patrol_probability").alias("weight"))


def explore_allocation(zones: DataFrame, epsilon: float = 0.1, alpha: float = 1.5) -> DataFrame:
    """Mix of priority^alpha and 1/(1+count); each part falls back to uniform when it sums to zero.

    Works on any number of zones: the sums are scalar subqueries, not windows.
    """
    exploit = F.pow(F.greatest("risk_score", dbl(0.0)), dbl(alpha))
    explore = dbl(1.0) / (dbl(1.0) + F.greatest(F.col("violation_count").cast("double"), dbl(0.0)))
    sums = zones.agg(F.sum(exploit).alias("a"), F.sum(explore).alias("b"), F.count("*").alias("n"))
    packed = sums.select(F.struct("a", "b", "n")).scalar()
    even = dbl(1.0) / packed.getField("n")
    first = F.when(packed.getField("a") > 0, exploit / packed.getField("a")).otherwise(even)
    second = F.when(packed.getField("b") > 0, explore / packed.getField("b")).otherwise(even)
    return zones.select("zone_id", "risk_score", "violation_count",
                        (dbl(1 - epsilon) * first + dbl(epsilon) * second).alias("allocation"))


def game_summary(served: DataFrame) -> DataFrame:
    return served.agg(
        F.count("*").alias("zones"), F.max("patrol_probability").alias("max_patrol_prob"),
        F.avg("patrol_probability").alias("avg_patrol_prob"), F.avg("violator_risk_score").alias("avg_violator_risk"),
        F.max("violator_risk_score").alias("max_violator_risk"), F.avg("expected_cost").alias("avg_expected_cost"))


def volume_forecast(served: DataFrame, days: int = 151) -> DataFrame:
    """Daily volume as a stand-in forecast."""
    daily = F.col("violation_count").cast("double") / dbl(days)
    return served.select("zone_id", daily.alias("predicted_count"), (daily * dbl(0.8)).alias("confidence_lower"),
                         (daily * dbl(1.25)).alias("confidence_upper"))


def index_curve(scored: DataFrame, top: int | None = None, bucket: str = V.ALL_DAY, teams: int = 20,
                effect: float = 0.6, alpha: float = 1.5, minutes: float = 45.0) -> DataFrame:
    """Congestion index before and after for 1..teams patrol teams over all zones, or the ``top`` ones."""
    rows = at_bucket(scored, bucket).select("zone_id", F.round("congestion_impact", 6).alias("impact"))
    if top is not None:
        rows = best(rows, top, F.col("impact").desc(), F.col("zone_id"))
    rows = materialise(rows, "curve-impact")
    weight = F.pow(F.greatest("impact", dbl(0.0)), dbl(alpha))
    rows = rows.withColumn("p", ratio(weight, rows.agg(F.sum(weight)).scalar()))
    spread = rows.withColumn("num_teams", F.explode(F.sequence(F.lit(1), F.lit(teams))))
    cover = dbl(1.0) - F.pow(dbl(1.0) - F.col("p"), F.col("num_teams").cast("double"))
    sums = spread.groupBy("num_teams").agg(
        F.sum(F.col("impact") / dbl(100.0)).alias("index_before"),
        F.sum(F.col("impact") * (dbl(1.0) - dbl(effect) * cover) / dbl(100.0)).alias("index_after"))
    saved = F.col("index_before") - F.col("index_after")
    return sums.withColumns({"pct_reduction": ratio(saved, F.col("index_before")) * dbl(100.0),
                             "minutes_saved": saved * dbl(minutes)})


def stories(zones: DataFrame, hour: int = 9) -> DataFrame:
    """Explanation text per zone."""
    text = L.zone_story(F.col("zone_id"), F.col("road_name"), F.col("station"), F.col("congestion_impact"), F.col("impact_band"),
                        hour, F.col("violation_count"), F.col("top_violation"), F.col("lane_hours"),
                        F.col("travel_time_ratio"), F.col("calibrated_score"))
    return zones.select("zone_id", text.alias("explanation"))


def resolved(ids: DataFrame, served: DataFrame, scored: DataFrame) -> DataFrame:
    """Explanation input for any id: the served row if there is one, else the zone's breakdown."""
    fields = ["station", "congestion_impact", "impact_band", "violation_count", "top_violation", "lane_hours",
              "travel_time_ratio", "calibrated_score", "road_name"]
    first = served.select("zone_id", F.struct(*fields).alias("s"))
    day = at_bucket(scored, V.ALL_DAY).select(
        "zone_id", F.struct(
            "station", "congestion_impact", "impact_band", F.col("total_records").alias("violation_count"),
            F.get("top_violations", F.lit(0)).alias("top_violation"), "lane_hours", "travel_time_ratio",
            F.lit(None).cast("double").alias("calibrated_score"), F.lit(None).cast("string").alias("road_name")).alias("z"))
    joined = ids.select("zone_id").join(first, "zone_id", "left").join(day, "zone_id", "left")
    known = joined.where(F.col("s").isNotNull() | F.col("z").isNotNull())
    return known.select("zone_id", F.when(F.col("s").isNotNull(), 1).otherwise(0).alias("is_served"),
                        F.coalesce("s", "z").alias("row")).select("zone_id", "is_served", "row.*")


def selection(scored: DataFrame, core: int = 110, explore: int = 40, seed: int = 7) -> DataFrame:
    """Core zones by volume plus a repeatable sample of the rest, ordered by a hash of the id."""
    day = at_bucket(scored, V.ALL_DAY).select("zone_id", "total_records", "lat", "lon", "station")
    first = materialise(day.orderBy(F.col("total_records").desc(), "zone_id").limit(core), "core-zones")
    rest = day.join(first.select("zone_id"), "zone_id", "left_anti")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("zone_id")), 256)
    sampled = rest.orderBy(draw, "zone_id").limit(explore)
    return first.withColumn("is_exploration", F.lit(0)).unionByName(sampled.withColumn("is_exploration", F.lit(1)))


def calls_needed(chosen: DataFrame, existing: DataFrame, budget: int, per_zone: int = 10) -> DataFrame:
    """Zones still to collect and whether their calls fit the budget."""
    todo = chosen.join(existing.select("zone_id"), "zone_id", "left_anti")
    return todo.agg(F.count("*").alias("zones_to_do")).select(
        "zones_to_do", (F.col("zones_to_do") * per_zone).alias("calls"),
        F.when(F.col("zones_to_do") * per_zone <= budget, 1).otherwise(0).alias("fits_budget"))


def top_difference(first: DataFrame, second: DataFrame, top: int = 50) -> DataFrame:
    """Added, dropped and moved zones between two scorings of (zone_id, score)."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("zone_id", F.round("score", 6).alias("score"))
        return best(rows, top, F.col("score").desc(), F.col("zone_id")).select("zone_id", F.col("place").alias(name))

    both = ranked(first, "old_place").join(ranked(second, "new_place"), "zone_id", "full")
    status = F.when(F.col("old_place").isNull(), "added").when(F.col("new_place").isNull(), "dropped").otherwise("kept")
    return both.select("zone_id", "old_place", "new_place", status.alias("status"),
                       (F.col("old_place") - F.col("new_place")).alias("delta"))
