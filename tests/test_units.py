"""Golden values from the reference's shipped evidence and hand computations."""

import math

from pyspark.sql import functions as F

from roadrisk.functions.scalar import bearing_degrees, haversine_miles, hash_id, time_of_day
from roadrisk.operators import drivers as D
from roadrisk.operators import evaluation as V
from roadrisk.operators import features as FE
from roadrisk.operators import scoring as S


def test_golden_driver_ids(spark):
    # recorded device -> hashed driver id pairs (salted sha256, 16 hex)
    gold = {"device_A1B2C3": "5ca1ee59bec791ff", "device_D4E5F6": "576171927e6853a2",
            "device_G7H8I9": "c06a7c594ea3c8ba", "device_J1K2L3": "47974ba58d62bd82",
            "device_M4N5O6": "03de60531bb56cc9"}
    df = spark.createDataFrame([(k,) for k in gold], "d string")
    got = {r[0]: r[1] for r in df.select("d", hash_id("d").alias("h")).collect()}
    assert got == gold


def test_time_bins(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    got = {r[0]: r[1] for r in df.select("h", time_of_day("h")).collect()}
    assert got[4] == "night" and got[5] == "early_morning" and got[7] == "morning_commute"
    assert got[9] == "midday" and got[16] == "evening_commute" and got[19] == "evening" and got[22] == "night"


def test_haversine_bearing(spark):
    df = spark.createDataFrame([(37.0, -122.0, 38.0, -122.0)], "a double, b double, c double, d double")
    r = df.select(haversine_miles("a", "b", "c", "d"), bearing_degrees("a", "b", "c", "d")).first()
    assert abs(r[0] - 3959 * math.radians(1)) < 1e-6
    assert abs(r[1] - 0.0) < 1e-9


def test_driver_aggregation_example(spark):
    rows = [(1, 101, 30.0, 10.0, 20.0, 30.0, 1, 0, 1, 120, 10.0, 0.2, 0.5, "day"),
            (1, 102, 45.0, 15.0, 25.0, 35.0, 2, 1, 0, 180, 15.0, 0.3, 0.6, "night"),
            (2, 201, 20.0, 5.0, 15.0, 20.0, 0, 1, 0, 60, 5.0, 0.1, 0.4, "day"),
            (2, 202, 25.0, 7.0, 14.0, 22.0, 1, 0, 1, 90, 8.0, 0.2, 0.5, "night")]
    schema = ("driver_id int, trip_id int, duration_minutes double, distance_miles double, average_speed_mph double, "
              "max_speed_mph double, harsh_braking_events int, harsh_acceleration_events int, "
              "sharp_cornering_events int, phone_usage_seconds int, speeding_percent double, night_driving double, "
              "rush_hour double, time_of_day string")
    d = {r["driver_id"]: r for r in D.driver_features_basic(spark.createDataFrame(rows, schema)).collect()}
    assert d[1]["total_trips"] == 2 and d[1]["duration_minutes_sum"] == 75 and d[1]["distance_miles_sum"] == 25
    assert abs(d[1]["events_per_mile"] - 0.2) < 1e-12 and abs(d[1]["phone_usage_per_hour"] - 240) < 1e-9
    assert abs(d[1]["average_speed_mph_std"] - math.sqrt(12.5)) < 1e-12 and d[1]["night_driving_pct"] == 0.5
    assert abs(d[2]["events_per_mile"] - 0.25) < 1e-12 and abs(d[2]["phone_usage_per_hour"] - 200) < 1e-9


def test_57_features_with_absent_columns(spark):
    rows = [(30.0, 25.0, 120.0, 50.0, 2.0, 1.0, 5.0, 2.0), (45.0, 40.0, 90.0, 53.3, 0.0, 0.0, 0.0, 0.0),
            (20.0, 15.0, 150.0, 45.0, 5.0, 3.0, 10.0, 8.0)]
    df = spark.createDataFrame(rows, "trip_duration_minutes double, trip_distance_km double, max_speed_kmh double, "
                                     "avg_speed_kmh double, hard_braking_count double, hard_acceleration_count double,"
                                     " night_driving_minutes double, phone_use_minutes double")
    f = FE.create_features(df)
    assert f.columns == FE.FEATURE_NAMES
    r = f.collect()
    assert r[0]["sharp_turn_count"] == 0.0 and r[0]["weather_risk_score"] == 0.0
    assert abs(r[0]["avg_trip_speed"] - 50.0) < 1e-12 and r[2]["very_high_speed_indicator"] == 1.0
    assert abs(r[0]["hard_braking_rate"] - 2 / 25) < 1e-12 and r[0]["composite_risk_score"] <= 1.0
    assert abs(r[2]["speeding_severity"] - 0.5) < 1e-12


def test_risk_score_category(spark):
    df = spark.createDataFrame([(0.0999, 60000.0), (0.1, 10000.0), (0.5, 0.0), (0.75, 25000.0)], "p double, s double")
    r = df.select(S.risk_score("p", "s").alias("rs"), S.risk_category("p").alias("c")).collect()
    assert [x["c"] for x in r] == ["Very Low", "Low", "High", "Very High"]
    assert abs(r[0]["rs"] - min((0.6 * 0.0999 + 0.4) * 100, 100)) < 1e-9 and abs(r[2]["rs"] - 30.0) < 1e-9


def test_confusion_golden(spark):
    # recorded test split: tn 3479, fp 0, fn 85, tp 0, constant scores
    rows = [(0, 0.1, 0)] * 3479 + [(1, 0.1, 0)] * 85
    df = spark.createDataFrame(rows, "label int, score double, prediction int")
    m = V.classification_metrics(df).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (3479, 0, 85, 0)
    assert abs(m["accuracy"] - 3479 / 3564) < 1e-12 and m["precision"] == 0.0 and m["f1"] == 0.0
    assert V.roc_auc(df).first()["roc_auc"] == 0.5
    assert abs(V.average_precision(df).first()["average_precision"] - 85 / 3564) < 1e-12


def test_auc_matches_pairwise_definition(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.random() < 0.3, round(rnd.random(), 2)) for _ in range(400)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "label int, score double")
    got = V.roc_auc(df, buckets=7).first()["roc_auc"]
    assert abs(got - want) < 1e-12
