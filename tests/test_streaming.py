"""Structured Streaming forms agree with their batch definitions."""

from pyspark.sql import functions as F

from roadrisk.config import TESTDATA_CONFIG
from roadrisk.operators.events import detect_events
from roadrisk.plans import views
from roadrisk.streaming.streams import _debounced_count
from tests.conftest import SF

import __spark_entry__ as E


def test_debounce_fold(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([([{"seq": i, "flag": f} for i, f in enumerate(flags)],)],
                               "pairs array<struct<seq:bigint,flag:int>>")
    # runs of 2 (never), 4 (two hits), 3 (one hit)
    assert df.select(_debounced_count(F.col("pairs"), 3)).first()[0] == 3
    assert df.select(_debounced_count(F.col("pairs"), 1)).first()[0] == sum(flags)


def test_stream_event_counts_equal_batch(spark):
    s = E.queries()["stream_event_counts"](spark, SF)
    b = detect_events(views.readings(spark, SF), TESTDATA_CONFIG).groupBy(
        F.window("timestamp", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("readings"), F.sum("harsh_brake").alias("harsh_brake"),
        F.sum("phone_raw").alias("phone_raw")).select(
        F.col("w.start").alias("window_start"), "readings", "harsh_brake", "phone_raw")
    got = s.select("window_start", "readings", "harsh_brake", "phone_raw")
    # every window, the last ones too
    assert got.exceptAll(b).count() == 0 and b.exceptAll(got).count() == 0
    assert got.agg(F.sum("readings")).first()[0] == views.readings(spark, SF).count()


def test_stream_monitor_counts_every_prediction(spark):
    got = E.queries()["stream_monitor"](spark, SF).agg(F.sum("total_predictions")).first()[0]
    assert got == views.scored(spark, SF).count()


def test_stream_trip_debounce_equals_batch_sessions(spark):
    from pyspark.sql import Window
    from roadrisk.functions.scalar import hash_id

    s = E.queries()["stream_trip_summary"](spark, SF).select("driver_id", "session_start", "phone_usage_seconds")
    r = detect_events(views.readings(spark, SF), TESTDATA_CONFIG)
    w = Window.partitionBy("device_id").orderBy("reading_seq")
    gap = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w))
    r = r.withColumn("new", F.coalesce(gap >= 86_400_000_000, F.lit(True)).cast("int")) \
         .withColumn("sid", F.sum("new").over(w))
    ws = Window.partitionBy("device_id", "sid").orderBy("reading_seq").rowsBetween(-2, 0)
    r = r.withColumn("use", (F.sum("phone_raw").over(ws) >= 3).cast("int"))
    b = r.groupBy("device_id", "sid").agg(F.min("timestamp").alias("session_start"),
                                          F.sum("use").cast("long").alias("phone_usage_seconds")) \
        .select(hash_id("device_id").alias("driver_id"), "session_start", "phone_usage_seconds")
    assert s.exceptAll(b).count() == 0
    # every session that passes the quality gates is there
    from roadrisk.operators.trips import with_quality
    r = r.groupBy("device_id", "sid").agg(
        F.count(F.lit(1)).alias("n_readings"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        F.avg("gps_accuracy_meters").alias("gps_accuracy_avg"), F.max("speed_mph").alias("max_speed_mph"),
        F.avg("speed_mph").alias("average_speed_mph"), F.min("gps_latitude").alias("lat_min"), F.max("gps_latitude").alias("lat_max"),
        F.min("gps_longitude").alias("lon_min"), F.max("gps_longitude").alias("lon_max"))
    assert s.count() == with_quality(r, TESTDATA_CONFIG).filter("is_valid = 1").count()


def _readings(spark, folder):
    from roadrisk.streaming import streams as X
    return views.readings_from_events(X.stream_source(spark, folder, X.EVENTS_SCHEMA))


def _land(spark, folder, parts):
    """Write the parts of the events one after the other; yields after each."""
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(folder)
        yield i


def _parts(spark, by):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    return [ev.filter(F.expr(by) == i) for i in (0, 1)]


def _half(spark):
    mid = spark.read.parquet(f"{SF}/events.parquet").selectExpr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)").first()[0]
    return f"int(unix_micros(cast(ts as timestamp)) > {mid})"


def test_event_counts_go_on_when_more_comes(spark, tmp_path):
    from roadrisk.streaming import streams as X
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    total = views.readings(spark, SF).count()
    # halves by id: the second file holds rows older than all of the first's latest
    for i in _land(spark, folder, _parts(spark, "event_id % 2")):
        got = X.stream_event_counts(_readings(spark, folder), out, TESTDATA_CONFIG, window="1 hour")
    assert got.agg(F.sum("readings")).first()[0] == total
    whole = X.event_counts(views.readings(spark, SF), TESTDATA_CONFIG, "1 hour")
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    slid = X.stream_event_counts(_readings(spark, folder), str(tmp_path / "slid"), TESTDATA_CONFIG, window="1 hour", slide="15 minutes")
    assert slid.agg(F.sum("readings")).first()[0] == 4 * total


def test_trips_go_on_when_more_comes(spark, tmp_path):
    from roadrisk.streaming import streams as X
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    r = views.readings(spark, SF)
    want = X.fold_sessions(X.with_sessions(detect_events(r, TESTDATA_CONFIG), "1 day"), TESTDATA_CONFIG, "1 day")
    run = lambda: X.stream_trip_summary(_readings(spark, folder), out, TESTDATA_CONFIG, gap="1 day", watermark="1 day")
    for i in _land(spark, folder, _parts(spark, _half(spark))):
        got = run()
        if i == 0:
            # sessions that the cut leaves open are there, and stay open
            assert got.count() and spark.read.parquet(out + "/open/batch_id=0").count()
    key = ["driver_id", "session_start", "session_end", "phone_usage_seconds", "harsh_braking_events"]
    got, want = got.select(*key), want.select(*key)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(out + "/late").count() == 0
    assert run().count() == want.count()  # nothing new: the same again


def test_readings_within_the_watermark_are_put_in_order(spark, tmp_path):
    from roadrisk.streaming import streams as X
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = _parts(spark, "event_id % 2")
    for _ in _land(spark, folder, parts):
        # nothing is late with a watermark longer than the data
        got = X.stream_trip_summary(_readings(spark, folder), out, TESTDATA_CONFIG, gap="1 day", watermark="3650 days")
    want = X.fold_sessions(X.with_sessions(detect_events(views.readings(spark, SF), TESTDATA_CONFIG), "1 day"), TESTDATA_CONFIG, "1 day")
    key = ["driver_id", "session_start", "session_end", "phone_usage_seconds"]
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0 and got.count() == want.count()


def test_late_readings_are_kept_aside(spark, tmp_path):
    from roadrisk.streaming import streams as X
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = _parts(spark, _half(spark))
    for _ in _land(spark, folder, [second, first]):
        X.stream_trip_summary(_readings(spark, folder), out, TESTDATA_CONFIG, gap="1 day", watermark="1 day")
    mark = spark.read.parquet(out + "/progress/batch_id=0").first()["watermark"]
    assert spark.read.parquet(out + "/late").count() == views.readings_from_events(first).filter(F.col("timestamp") < F.lit(mark)).count() > 0


def test_record_source_counts_each_record_once(spark, tmp_path):
    from roadrisk.streaming import streams as X
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
    rows = [(b"d1", b'{"device_id": "d1", "speed": 3.5}', "readings", 0, 1), (b"d1", b'{"device_id": "d1", "speed": 4.5}', "readings", 0, 2),
            (b"d1", b'{"device_id": "d1", "speed": 3.5}', "readings", 0, 1), (b"d2", b"not json", "readings", 1, 1), (None, None, "readings", 1, 2)]
    import datetime
    df = spark.createDataFrame([(*r, datetime.datetime(2024, 1, 1, 0, i)) for i, r in enumerate(rows)], schema)
    path = str(tmp_path / "records")
    df.coalesce(1).write.parquet(path)
    fields = spark.createDataFrame([], "device_id string, speed double").schema
    stream = X.read_records(X.stream_source(spark, path, df.schema), fields)
    got = X.run_foreach_batch(stream, str(tmp_path / "out")).drop("batch_id")
    assert sorted((r.partition, r.offset, r.device_id, r.speed) for r in got.collect()) == [(0, 1, "d1", 3.5), (0, 2, "d1", 4.5), (1, 1, None, None), (1, 2, None, None)]
    batch = X.read_records(df, fields)
    assert batch.count() == 4


def test_sessions_of_one_device_meet_over_slots(spark):
    import datetime
    from roadrisk.streaming import streams as X
    at = [0, 4, 8, 13, 18, 22, 22.5, 40]
    t0 = datetime.datetime(2024, 1, 1, 0, 3)
    df = spark.createDataFrame([("d", t0 + datetime.timedelta(minutes=m)) for m in at] + [(None, t0), (None, None)], "device_id string, timestamp timestamp_ntz")
    got = sorted((r.device_id or "", (r.session_start - t0).seconds / 60, (r.session_last - t0).seconds / 60, n) for r, n in
                 ((r, r["count"]) for r in X.with_sessions(df, "5 minutes").groupBy("device_id", "session_start", "session_last").count().collect()))
    # a silence of exactly the gap ends a session
    assert got == [("", 0, 0, 1), ("d", 0, 8, 3), ("d", 13, 13, 1), ("d", 18, 22.5, 3), ("d", 40, 40, 1)]


def test_streams_without_input(spark, tmp_path):
    from roadrisk.streaming import streams as X
    folder = str(tmp_path / "none")
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(folder)
    for n in range(2):
        assert X.stream_event_counts(_readings(spark, folder), str(tmp_path / "a"), TESTDATA_CONFIG, window="1 hour").count() == 0
        assert X.stream_trip_summary(_readings(spark, folder), str(tmp_path / "b"), TESTDATA_CONFIG, gap="1 day").count() == 0
