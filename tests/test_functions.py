import datetime as dt
import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbflow.functions import events as E
from kerbflow.functions import geo as G
from kerbflow.functions import labels as L
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import bounded, digest_mod, moving_label, split_of, valid_ratio


def column(df, expression):
    return [row[0] for row in df.select(expression).collect()]


def test_label_list_accepts_every_shape(spark):
    texts = ['["wrong parking", " NO PARKING "]', "[]", "", None, "null", "[A, 'b']", '"single"', "[\"\", \"X\"]", "loose, text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert column(df, E.label_list("t")) == [
        ["WRONG PARKING", "NO PARKING"], [], [], [], [], ["A", "B"], ["SINGLE"], ["X"], ["LOOSE", "TEXT"]]
    arrays = spark.createDataFrame([(["a ", "", "B"],), (None,)], "t array<string>")
    assert sorted(column(arrays, E.label_list("t", True))) == [[], ["A", "B"]]


def test_local_time_reads_offsets_and_fractions(spark):
    texts = ["2024-03-15T08:15:00+05:30", "2024-03-15 02:45:00.123456+00", "2024-03-15 02:45:00", "not a time", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [r.local_ts for r in E.with_local_time(df, "t").orderBy("i").collect()]
    assert [r.replace(microsecond=0) if r else None for r in rows] == [dt.datetime(2024, 3, 15, 8, 15)] * 3 + [None, None]


def test_pincode_rules(spark):
    df = spark.createDataFrame([(0, "A, PIN 560001"), (1, "at 123456 road"), (2, "pin-56001 x"), (3, "none"), (4, None)], "i int, t string")
    assert column(df.orderBy("i"), E.pincode(F.col("t"))) == [None if i in (3, 4) else v for i, v in enumerate(["560001", "123456", "56001", 0, 0])]


def test_digest_mod_equals_big_integer(spark):
    ids = [f"z9_{i}_{i * 7}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "zone_id string")
    got = {r[0]: (r[1], r[2]) for r in df.select("zone_id", digest_mod("concat('1337:', zone_id)", 100), split_of("zone_id", 1337)).collect()}
    for name in ids:
        bucket = int(hashlib.sha256(f"1337:{name}".encode()).hexdigest(), 16) % 100
        assert got[name] == (bucket, "train" if bucket < 70 else "test")


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (25.0, 25.01, 50.0, 75.0, 75.01)], "v double")
    assert column(df, moving_label(F.col("v"))) == ["MINIMAL", "MODERATE", "MODERATE", "SEVERE", "CRITICAL"]
    assert column(df, L.risk_tier(F.col("v") + 8)) == ["LOW", "MEDIUM", "MEDIUM", "CRITICAL", "CRITICAL"]


def test_valid_ratio_and_clamp_keep_nulls(spark):
    df = spark.createDataFrame([(1.5,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert column(df, valid_ratio(F.col("v"))) == [True, False, False, False, False, False]
    assert column(df.where("v IS NULL"), bounded(F.col("v"))) == [None]


def test_vehicle_lookup_defaults(spark):
    df = spark.createDataFrame([("bus",), (" Truck ",), ("SPACESHIP",), (None,)], "v string")
    assert column(df, E.obstruction(F.col("v"))) == [2.0, 1.8, 1.0, 1.0]
    assert column(df, E.severity(F.col("v"))) == [0.9, 1.0, 0.4, 0.4]


def test_weights_sum_to_one():
    assert abs(sum(V.IMPACT_WEIGHTS.values()) - 1) < 1e-9
    assert abs(sum(V.RISK_WEIGHTS.values()) - 1) < 1e-9


def test_hexagons_contain_their_centres(spark):
    points = [(12.8 + 0.011 * i, 77.4 + 0.007 * j) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(points, "lat double, lon double")
    q, r = G.hex_axial(F.col("lat"), F.col("lon"), 0.2, 13.0)
    df = df.select(q.alias("q"), r.alias("r"))
    lat, lon = G.hex_centre(F.col("q"), F.col("r"), 0.2, 13.0)
    back = df.withColumns({"lat": lat, "lon": lon})
    q2, r2 = G.hex_axial(F.col("lat"), F.col("lon"), 0.2, 13.0)
    assert back.where((q2 != F.col("q")) | (r2 != F.col("r"))).count() == 0


@given(st.lists(st.floats(0, 1), min_size=5, max_size=5))
def test_score_is_a_convex_combination(parts):
    score = 100 * sum(w * c for w, c in zip(V.IMPACT_WEIGHTS.values(), parts))
    assert -1e-9 <= score <= 100 + 1e-9
