"""The given ``events`` table seen as a geo-tagged, multi-label violation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import digest_mod

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

_PROJECTION = [
    "CAST(event_id AS STRING) AS id",
    "12.8D + CAST(user_id % 15 AS DOUBLE) * 0.0075D + CAST(event_id % 7 AS DOUBLE) * 0.0004D AS latitude",
    "77.44D + (CAST(user_id - user_id % 15 AS DOUBLE) / 15D) * 0.0105D + CAST(event_id % 5 AS DOUBLE) * 0.0004D AS longitude",
    "concat('Stop ', user_id % 40, ', Bengaluru. Pin-56', 1000 + user_id % 60, ' (India)') AS location",
    "concat('V', user_id) AS vehicle_number",
    "get(array('CAR', 'SCOOTER', 'MOTOR CYCLE', 'BUS', 'LGV', 'MAXI-CAB', 'TRACTOR'), CAST(event_id % 7 AS INT)) AS vehicle_type",
    "CASE event_id % 11 WHEN 0 THEN 'CAR' WHEN 1 THEN 'NULL' END AS updated_vehicle_type",
    """CASE event_type WHEN 'error' THEN '["DOUBLE PARKING"]'
         WHEN 'purchase' THEN '["PARKING IN A MAIN ROAD","WRONG PARKING"]'
         WHEN 'signup' THEN '["PARKING NEAR ROAD CROSSING"]'
         WHEN 'click' THEN '["WRONG PARKING","PARKING ON FOOTPATH"]' ELSE '["NO PARKING"]' END AS violation_type""",
    "ts AS created_datetime",
    "timestampadd(MINUTE, event_id * 37 % 2000 - 20, ts) AS modified_datetime",
    "CASE WHEN event_id % 6 <> 5 THEN timestampadd(MINUTE, event_id * 53 % 9000 - 5, ts) END AS validation_timestamp",
    "concat('Station ', user_id % 12) AS police_station",
    "CASE WHEN user_id % 12 <> 5 THEN concat('C', user_id % 12) END AS center_code",
    "concat('D', event_id % 23) AS device_id",
    """CASE WHEN user_id % 3 = 0 THEN 'No Junction'
         WHEN user_id % 17 <> 0 THEN concat('Junction ', user_id % 9) END AS junction_name""",
    "get(array('approved', 'approved', 'rejected', 'created1', 'pending', NULL), CAST(event_id % 6 AS INT)) AS validation_status",
    "CAST(get_json_object(props, '$.k') AS BIGINT) AS signal",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Row-wise projection of ``events``; no shuffle, columns pruned to the ones used later."""
    return spark.read.schema(_EVENTS).parquet(f"{folder}/events.parquet").selectExpr(*_PROJECTION)


def travel_ratios(placed: DataFrame) -> DataFrame:
    """Travel ratio of the zones that count as measured, from the signal of their events.

    ``placed`` has ``zone_id`` and ``signal``; about 60 % of the zones get a ratio.
    """
    return measured_ratios(placed.groupBy("zone_id").agg(F.sum("signal").alias("total"), F.count("signal").alias("n")))


def measured_ratios(per_zone: DataFrame) -> DataFrame:
    """The same from one row per zone with the sum ``total`` and the number ``n`` of its signals."""
    # The test names n as well, so it stays above the aggregate: one hash per zone, not per event.
    chosen = F.when(F.col("n") > 0, digest_mod("concat('measure:', zone_id)", 100)) < 60
    measured = per_zone.where(chosen)
    return measured.selectExpr("zone_id", "1D + CAST(total AS DOUBLE) / CAST(n AS DOUBLE) / 50D AS travel_time_ratio")


def _hex(text: str, start: int) -> str:
    return f"CAST(conv(substr(md5({text}), {start}, 8), 16, 10) AS BIGINT)"


def leg_records(ratios: DataFrame) -> DataFrame:
    """Nested observation of each measured zone: four legs, points of interest, context."""
    legs = []
    for name, _, _ in V.LEG_OFFSETS:
        text = f"concat(zone_id, ':{name}')"
        base = f"CAST(60 + {_hex(text, 1)} % 61 AS DOUBLE)"
        legs.append(
            f"named_struct('direction', '{name}', 'baseline_s', {base},"
            f" 'eta_s', {base} * (1D + CAST({_hex(text, 9)} % 120 AS DOUBLE) / 100D),"
            f" 'distance_m', CASE WHEN {_hex(text, 17)} % 3 <> 0 THEN CAST(200 + {_hex(text, 17)} % 900 AS DOUBLE) END)")
    poi = "concat('poi:', zone_id)"
    return ratios.selectExpr(
        "zone_id", "travel_time_ratio",
        # Tied to the ratio so that the optimiser cannot move the hashes below the aggregate onto event rows.
        f"CASE WHEN travel_time_ratio IS NOT NULL THEN array({', '.join(legs)}) END AS raw_legs",
        f"transform(sequence(1, 1 + CAST({_hex(poi, 1)} % 7 AS INT)), i -> named_struct('name', concat('poi ', i))) AS pois",
        f"CASE WHEN {_hex(poi, 9)} % 4 = 0 THEN 1 ELSE 0 END AS is_exploration",
        f"concat('Road ', {_hex(poi, 17)} % 50, CASE WHEN {_hex(poi, 17)} % 5 = 0 THEN ' Main Road' ELSE ' Cross' END) AS road_name",
    )
