"""S1-S5, N1-N5 on literal JSON documents in the five shapes."""

import json

from pyspark.sql import functions as F

from roadrisk.config import DEFAULT_CONFIG
from roadrisk.operators import trips as TR
from roadrisk.sources.readings_json import parse_documents, read_readings_json


def reading(i, **kw):
    r = {"timestamp": f"2025-06-16T08:00:{i:02d}", "gps_latitude": 37.0 + i / 1000, "gps_longitude": -122.0,
         "gps_accuracy_meters": 10.0, "speed_mph": 30.0, "accelerometer_x": 0.0, "accelerometer_y": 0.0,
         "accelerometer_z": 9.81, "screen_on": 0, "app_foreground": "com.maps"}
    r.update(kw)
    return r


def write(d, name, obj):
    p = d / name
    p.write_text(json.dumps(obj))
    return p


def test_five_shapes_and_trip_identity(spark, tmp_path):
    rd = [reading(i) for i in range(5)]
    write(tmp_path, "a.json", [{"trip_metadata": {"trip_id": "t_a1", "device_id": "dev_a"}, "sensor_readings": rd},
                               {"trip_metadata": {"trip_id": "t_a2", "device_id": "dev_a"}, "sensor_readings": rd[:3]},
                               {"trip_metadata": {"trip_id": "t_empty"}, "sensor_readings": []}])
    write(tmp_path, "b.json", [dict(r, trip_id="trip_001", device_id="dev_b") for r in rd])
    write(tmp_path, "c.json", {"trip_metadata": {"trip_id": "t_c", "device_id": "dev_c"}, "sensor_readings": rd})
    write(tmp_path, "d.json", {"description": "x", "trip_id": "trip_001", "readings": rd[:4]})
    write(tmp_path, "e.json", {"trip_id": "t_e", "device_id": "dev_e", "speed_mph": "12.5"})
    r = read_readings_json(spark, str(tmp_path))
    per = {row["trip_key"].split("/")[-1]: (row["n"], row["tid"], row["dev"]) for row in r.groupBy("trip_key").agg(
        F.count(F.lit(1)).alias("n"), F.first("trip_id").alias("tid"), F.first("device_id").alias("dev")).collect()}
    assert per["a.json#0#0"] == (5, "t_a1", "dev_a")
    assert per["a.json#0#1"] == (3, "t_a2", "dev_a")
    assert "a.json#0#2" not in per  # empty sensor_readings -> no trip
    assert per["b.json#0#0"] == (5, "trip_001", "dev_b")
    assert per["c.json#0#0"] == (5, "t_c", "dev_c")
    # shape d: trip_id comes from the file stem because readings carry none;
    # same trip_id "trip_001" in b and d stays two trips (trip_key differs)
    assert per["d.json#0#0"] == (4, "d", "unknown_device")
    assert per["e.json#0#0"] == (1, "t_e", "dev_e")
    e = r.filter(F.col("trip_key").endswith("e.json#0#0")).first()
    assert e["speed_mph"] == 12.5 and e["gps_accuracy_meters"] == 20.0 and e["accelerometer_z"] == 9.81
    assert e["app_foreground"] == "unknown"
    assert str(e["timestamp"]) == "2024-01-01 00:00:00"


def test_coercion_defaults_and_bad_timestamps(spark, tmp_path):
    rd = [reading(0, speed_mph="7.5"), reading(1, speed_mph=None), reading(2, speed_mph="garbage"),
          reading(3, app_foreground=None)]
    for x in rd:
        x.pop("gps_accuracy_meters")
    write(tmp_path, "q.json", rd)
    write(tmp_path, "bad.json", [reading(0), reading(1, timestamp="not a time")])
    r = read_readings_json(spark, str(tmp_path)).orderBy("trip_key", "reading_seq").collect()
    assert [x["speed_mph"] for x in r] == [7.5, 0.0, 0.0, 30.0]  # present-but-bad -> 0
    assert all(x["gps_accuracy_meters"] == 20.0 for x in r)  # absent column -> default
    assert r[3]["app_foreground"] is None
    assert all("bad.json" not in x["trip_key"] for x in r)  # unparsable timestamp drops the trip


def test_event_thresholds_debounce_and_bins(spark, tmp_path):
    g = 0.3 * 9.81
    rd = [reading(0, accelerometer_x=-g), reading(1, accelerometer_x=-g - 0.01), reading(2, accelerometer_y=g + 0.01),
          reading(3, speed_mph=70.0), reading(4, speed_mph=70.1),
          reading(5, screen_on=1), reading(6, screen_on=1),  # run of 2: no phone use
          reading(7), reading(8, app_foreground="WhatsApp"), reading(9, screen_on=1), reading(10, screen_on=1)]
    for i in range(11, 70):
        rd.append(reading(i % 60, timestamp=f"2025-06-16T08:{i // 60:02d}:{i % 60:02d}"))
    write(tmp_path, "ev.json", rd)
    r = read_readings_json(spark, str(tmp_path))
    s = TR.summarize_trips(r, DEFAULT_CONFIG).first()
    assert s["harsh_braking_events"] == 1  # exactly -0.3 g is not an event
    assert s["sharp_cornering_events"] == 1
    assert s["phone_usage_seconds"] == 1  # run of 3 (rows 8-10) counts once; run of 2 never
    assert abs(s["speeding_percent"] - 1 / 70) < 1e-12  # 70 mph exactly is not speeding
    assert s["time_of_day"] == "morning_commute" and s["rush_hour"] == 1 and s["night_driving"] == 0


def test_quality_gates(spark, tmp_path):
    short = [reading(i) for i in range(6)]  # 5 s long
    write(tmp_path, "short.json", short)
    acc50 = [reading(i % 60, timestamp=f"2025-06-16T22:{i // 60:02d}:{i % 60:02d}", gps_accuracy_meters=50.0)
             for i in range(90)]
    write(tmp_path, "acc50.json", acc50)
    q = {row["trip_key"].split("/")[-1]: row for row in
         TR.trip_quality(read_readings_json(spark, str(tmp_path)), DEFAULT_CONFIG).collect()}
    assert q["short.json#0#0"]["issues"] == "trip_too_short"
    assert q["acc50.json#0#0"]["is_valid"] == 1  # average accuracy exactly 50 is accepted
    s = TR.summarize_trips(read_readings_json(spark, str(tmp_path)), DEFAULT_CONFIG).first()
    assert s["time_of_day"] == "night" and s["night_driving"] == 1


def test_malformed_files_give_no_trips_and_nan_is_zero(spark, tmp_path):
    from roadrisk.sources.readings_json import read_raw_documents, rejected_documents
    bad = {"a": "{not json at all", "b": "42", "c": '{"sensor_readings": [{"speed_mph": 3}', "d": '[{"speed_mph": 3}', "e": "null"}
    for n, t in bad.items():
        (tmp_path / f"{n}.json").write_text(t)
    (tmp_path / "good.json").write_text('{"readings": [{"speed_mph": "NaN", "trip_id": "t"}, {"speed_mph": 5, "trip_id": "t"}]}')
    got = read_readings_json(spark, str(tmp_path)).select("trip_id", "speed_mph").collect()
    assert sorted(tuple(r) for r in got) == [("t", 0.0), ("t", 5.0)]
    out = rejected_documents(read_raw_documents(spark, str(tmp_path))).select("value").collect()
    assert sorted(r.value for r in out) == sorted(bad.values())


def test_present_nulls_differ_from_absent_keys(spark, tmp_path):
    rd = [reading(i, gps_accuracy_meters=None, app_foreground=None, device_id=None, timestamp=None) for i in range(3)]
    write(tmp_path, "nulls.json", {"trip_metadata": {"device_id": "dev", "accelerometer_z": 1}, "sensor_readings": rd})
    write(tmp_path, "mixed.json", {"readings": [{"trip_id": "m", "speed_mph": 4}, {"trip_id": "m", "gps_accuracy_meters": 7}]})
    r = {}
    for x in read_readings_json(spark, str(tmp_path)).orderBy("reading_seq").collect():
        r.setdefault(x["trip_id"], []).append(x)
    assert [x["gps_accuracy_meters"] for x in r["nulls"]] == [0.0] * 3  # there, but null: not the default
    assert all(x["app_foreground"] is None and x["device_id"] is None for x in r["nulls"])
    assert [x["accelerometer_z"] for x in r["nulls"]] == [9.81] * 3  # the readings' own value wins
    assert [str(x["timestamp"]) for x in r["nulls"]][1] == "2024-01-01 00:00:01"  # no time at all: made up
    assert [(x["speed_mph"], x["gps_accuracy_meters"], x["accelerometer_z"]) for x in r["m"]] == [(4.0, 0.0, 9.81), (0.0, 7.0, 9.81)]


def test_metadata_of_any_key_fills_absent_columns(spark, tmp_path):
    rd = [{"speed_mph": 10}, {"speed_mph": 20}]
    meta = {"trip_id": "t", "scenario": "rain", "battery_level": 55, "gps_accuracy_meters": "3.5", "screen_on": True,
            "network_type": "5g", "timestamp": "2025-01-02T03:04:05", "weather": None}
    write(tmp_path, "m.json", [{"trip_metadata": meta, "sensor_readings": rd}])
    got = read_readings_json(spark, str(tmp_path)).orderBy("reading_seq").collect()
    assert [x["speed_mph"] for x in got] == [10.0, 20.0]
    for x in got:
        assert (x["battery_level"], x["gps_accuracy_meters"], x["screen_on"], x["network_type"]) == (55.0, 3.5, 1, "5g")
        assert str(x["timestamp"]) == "2025-01-02 03:04:05" and x["device_id"] == "unknown_device"
        assert x["metadata"]["scenario"] == "rain" and "weather" in x["metadata"]


def test_documents_without_any_reading_give_no_trips(spark, tmp_path):
    empty = [{"sensor_readings": None, "speed_mph": 3}, {"readings": None, "speed_mph": 3}, {"readings": []}, {}, [], [{}],
             {"sensor_readings": [{}]}, [{"sensor_readings": None}, {"sensor_readings": [{"speed_mph": 8, "trip_id": "only"}]}]]
    for i, d in enumerate(empty):
        write(tmp_path, f"{i}.json", d)
    assert [(x["trip_id"], x["speed_mph"]) for x in read_readings_json(spark, str(tmp_path)).collect()] == [("only", 8.0)]


def test_a_document_is_parsed_once_per_schema(spark):
    """An object, a list, a flat reading and a list of flat readings: four readings of the text at most."""
    d = spark.createDataFrame([("f", "0", "{}")], "file_path string, doc_no string, value string").repartition(1)
    plan = parse_documents(d)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_json(") <= 4
