from pyspark.sql import functions as F

from kerbflow.operators import checks, scoring, zones
from kerbflow.session import materialise

SCHEMA = ("latitude double, longitude double, created_datetime string, violation_type string, vehicle_type string, "
          "updated_vehicle_type string, junction_name string, police_station string")
ROWS = [
    (12.9716, 77.5946, "2024-03-15T02:00:00+05:30", '["DOUBLE PARKING"]', "CAR", None, "Junction A", "North"),
    (12.9717, 77.5947, "2024-03-15T07:10:00+05:30", '["PARKING IN A MAIN ROAD","WRONG PARKING"]', "BUS", "NULL", "No Junction", "North"),
    (12.9716, 77.5946, "2024-03-15T08:15:00+05:30", '["PARKING NEAR ROAD CROSSING"]', "SCOOTER", "CAR", "", "South"),
    (12.9352, 77.6245, "2024-03-15T11:00:00+05:30", '["PARKING ON FOOTPATH"]', "LGV", None, None, "South"),
    (12.9352, 77.6245, "2024-03-15T15:59:59+05:30", "[]", None, None, "NULL", None),
    (13.0358, 77.5970, "2024-03-15T09:00:00+05:30", '["DOUBLE PARKING"]', "CAR", None, "Junction B", "East"),
    (13.0358, 77.5970, "2024-03-15T18:20:00+05:30", '["DOUBLE PARKING"]', "BUS", None, "Junction B", "East"),
    (None, 77.5970, "2024-03-15T09:00:00+05:30", '["DOUBLE PARKING"]', "BUS", None, "Junction B", "East"),
    (13.0358, 77.5970, "broken", '["DOUBLE PARKING"]', "BUS", None, "Junction B", "East"),
]


def corpus(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def table(df):
    return zones.aggregate(zones.prepare(df))


def test_small_corpus(spark):
    rows = {(r.zone_id, r.time_bucket): r for r in table(corpus(spark)).collect()}
    assert len({z for z, _ in rows}) == 3 and len(rows) == 3 + 2 + 2 + 1
    busy = next(r for (z, b), r in rows.items() if b == "all_day" and r.total_records == 3)
    assert (busy.main_road_count, busy.double_park_count, busy.junction_violation_count) == (1, 1, 1)
    assert busy.station == "North" and busy.has_named_junction == 1
    assert abs(busy.mean_vehicle_obstruction - (1.0 + 2.0 + 1.0) / 3) < 1e-12
    late = next(r for (z, b), r in rows.items() if b == "all_day" and r.station == "East")
    assert late.total_records == 1  # the 18:20 row, the row without a place and the broken time are gone
    blank = next(r for (z, b), r in rows.items() if b == "afternoon")
    assert blank.station is None and blank.top_violations == []


def test_order_and_partitioning_do_not_matter(spark):
    expected = sorted(map(str, table(corpus(spark)).collect()))
    shuffled = corpus(spark).unionAll(corpus(spark).limit(0)).repartition(5, F.col("violation_type"))
    assert sorted(map(str, table(shuffled).collect())) == expected


def test_empty_corpus(spark):
    empty = table(corpus(spark).limit(0))
    assert zones.maxima(empty).first().asDict() == {
        "max_lane_load": 0.0, "max_junction_load": 0.0, "max_access_count": 0.0, "max_mean_obstruction": 0.0}


def test_score_contract_and_override(spark):
    stored = materialise(table(corpus(spark)), "test-zones")
    scored = scoring.score(stored)
    assert all(r.broken == 0 for r in checks.contract(scoring.nested(scored)).collect())
    assert scored.where("is_defaulted = 0 OR traffic_degradation <> 0.5").count() == 0
    one = scored.select("zone_id").first().zone_id
    changed = scoring.score(stored, overrides=spark.createDataFrame([(one, 0.9)], "zone_id string, degradation double"))
    got = {(r.zone_id, r.traffic_degradation, r.is_defaulted) for r in changed.collect()}
    assert (one, 0.9, 0) in got and all(v == (0.5, 1) for z, *v in [(z, t, d) for z, t, d in got if z != one] for v in [tuple(v)])


def test_levels_nest(spark):
    rows = zones.aggregate_levels(zones.prepare(corpus(spark))).where("time_bucket = 'all_day'").groupBy("level").agg(
        F.sum("total_records").alias("n")).collect()
    assert {r.level: r.n for r in rows} == {5: 6, 7: 6, 8: 6, 9: 6}
