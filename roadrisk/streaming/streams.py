"""Structured Streaming forms of the reading, scoring and monitoring
operators.

Row-count windows do not exist on streams, so a closed trip is a session of
one device (silence gap). Every micro-batch lands in ``foreachBatch`` under its
batch id (a replayed batch overwrites the same folders): window counts as
partial aggregates that add up on reading, readings of open sessions as a table
that the next micro-batch takes up. What is open when a query stops is folded on
reading and stays open, so that the query can go on whenever more input
comes. All folders are in the cluster's shared storage, next to the checkpoint.
"""

from __future__ import annotations

import os

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, ProcessingConfig
from ..operators.events import debounce_phone, detect_events
from ..operators.scoring import score_predictions
from ..operators.trips import summary_columns, with_quality

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def stream_source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream (parquet/json) with an explicit schema. A file path
    streams that file name from its folder (new files of the same name
    pattern are picked up as they land)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(path):
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return r.load(path)


def _debounced_count(pairs: Column, n: int) -> Column:
    """Rows whose last n flags (in sequence order) are all 1, from a sorted
    array of struct(seq, flag): a left fold carrying the current run length.
    (Batch helper for one trip's pairs.)"""
    init = F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("hits"))

    def step(acc, x):
        run = F.when(x["flag"] == 1, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), (acc["hits"] + F.when(run >= n, 1).otherwise(0)).alias("hits"))

    return F.aggregate(pairs, init, step, lambda acc: acc["hits"])


def _micros(gap: str) -> Column:
    """Microseconds of an interval, as a constant."""
    return F.expr(f"unix_micros(timestamp'2000-01-01' + INTERVAL {gap}) - unix_micros(timestamp'2000-01-01')")


def with_sessions(readings: DataFrame, gap: str, key: str = "device_id", time: str = "timestamp") -> DataFrame:
    """``readings`` plus session_start and session_last (event times). A session ends
    where nothing comes for ``gap``. Readings of one device in one slot as wide as
    the gap are always in one session, so only a row per (device, slot) is put in order;
    a device with very many readings is spread over its slots. Rows without time drop out."""
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp_ltz")) / _micros(gap))
    d = readings.filter(F.col(time).isNotNull()).withColumn("__slot", slot)
    slots = d.groupBy(key, "__slot").agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    w = Window.partitionBy(key).orderBy("__slot")
    new = F.coalesce(F.col("__a") - F.lag("__b").over(w) >= F.expr(f"INTERVAL {gap}"), F.lit(True))
    whole = Window.partitionBy(key, "__session")
    slots = slots.withColumn("__new", new.cast("int")).withColumn("__session", F.sum("__new").over(w)).select(
        F.col(key).alias("__key"), F.col("__slot").alias("__s"),
        F.min("__a").over(whole).alias("session_start"), F.max("__b").over(whole).alias("session_last"))
    return d.join(slots, d[key].eqNullSafe(F.col("__key")) & (F.col("__slot") == F.col("__s"))).drop("__key", "__slot", "__s")


def fold_sessions(flags: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG, gap: str = "5 minutes") -> DataFrame:
    """A1 over `detect_events` rows with sessions (`with_sessions`): phone debounce in reading order
    by bucketed lags, one algebraic aggregate per session, quality gates, summary columns."""
    d = flags.withColumn("__trip", F.struct("device_id", "session_start"))
    d = debounce_phone(d, cfg, key="__trip")
    g = d.groupBy("device_id", "session_start").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        F.avg("gps_accuracy_meters").alias("gps_accuracy_avg"),
        F.avg("speed_mph").alias("average_speed_mph"), F.max("speed_mph").alias("max_speed_mph"),
        F.min("gps_latitude").alias("lat_min"), F.max("gps_latitude").alias("lat_max"),
        F.min("gps_longitude").alias("lon_min"), F.max("gps_longitude").alias("lon_max"),
        F.sum("harsh_brake").cast("long").alias("harsh_braking_events"),
        F.sum("harsh_accel").cast("long").alias("harsh_acceleration_events"),
        F.sum("sharp_corner").cast("long").alias("sharp_cornering_events"),
        F.sum("phone_use").cast("long").alias("phone_usage_seconds"),
        F.avg("speeding").alias("speeding_percent"),
        F.min_by(F.struct("trip_id", "device_id", "gps_latitude", "gps_longitude", "timestamp"),
                 "reading_seq").alias("first"),
        F.max_by(F.struct("gps_latitude", "gps_longitude"), "reading_seq").alias("last"),
    )
    q = with_quality(g, cfg).filter("is_valid = 1").withColumn("session_end", F.col("end_time") + F.expr(f"INTERVAL {gap}"))
    return summary_columns(q, cfg, extra=("session_start", "session_end"))


def stream_trip_summary(readings: DataFrame, out_dir: str, cfg: ProcessingConfig = DEFAULT_CONFIG, gap: str = "5 minutes",
                        watermark: str = "10 minutes") -> DataFrame:
    """A1 on a stream, one trip per device session; runs over all input there is and
    returns the trips so far, sessions still open among them (`trips_so_far`).

    A micro-batch joins the readings of open sessions that the one before left. Sessions
    with nothing for ``gap`` before the watermark (latest event time less ``watermark``)
    are closed: debounced in reading order, whatever order they came in, folded and
    appended to data/. Readings older than the watermark of the batch before are late:
    they go to late/ instead, none are lost silently. ``out_dir`` may be run again
    when more input has come."""
    spark = readings.sparkSession
    at = lambda kind, n: os.path.join(out_dir, kind, f"batch_id={n}")

    def land(batch: DataFrame, n: int) -> None:
        f = detect_events(batch, cfg)
        before = None
        if n:
            before = spark.read.parquet(at("progress", n - 1)).first()["watermark"]
            late = F.col("timestamp") < F.lit(before)
            f.filter(late).write.mode("overwrite").parquet(at("late", n))
            f = f.filter(~F.coalesce(late, F.lit(False))).unionByName(spark.read.parquet(at("open", n - 1)))
        f.write.mode("overwrite").parquet(at("landed", n))
        f = spark.read.parquet(at("landed", n))
        mark = f.agg((F.max("timestamp") - F.expr(f"INTERVAL {watermark}")).alias("watermark"))
        if before is not None:
            mark = mark.select(F.greatest("watermark", F.lit(before)).alias("watermark"))
        mark.write.mode("overwrite").parquet(at("progress", n))
        now = spark.read.parquet(at("progress", n)).first()["watermark"]
        s = with_sessions(f, gap)
        over = F.col("session_last") + F.expr(f"INTERVAL {gap}") <= F.lit(now)
        s.filter(~over).select(*f.columns).write.mode("overwrite").parquet(at("open", n))
        fold_sessions(s.filter(over), cfg, gap).write.mode("overwrite").parquet(at("data", n))
        for kind in ("landed", "open"):  # what this batch has taken up
            drop_folder(spark, at(kind, n if kind == "landed" else n - 2))

    _run(readings, land, out_dir)
    if not _exists(spark, os.path.join(out_dir, "progress")):  # no input yet
        return fold_sessions(with_sessions(detect_events(spark.createDataFrame([], readings.schema), cfg), gap), cfg, gap)
    return trips_so_far(spark, out_dir, cfg, gap)


def trips_so_far(spark: SparkSession, out_dir: str, cfg: ProcessingConfig = DEFAULT_CONFIG, gap: str = "5 minutes") -> DataFrame:
    """Closed trips and, folded from their readings up to now, the open ones (these stay open)."""
    closed = spark.read.parquet(os.path.join(out_dir, "data"))
    # every batch leaves one row of progress, whether or not it closed a trip
    last = spark.read.parquet(os.path.join(out_dir, "progress")).agg(F.max("batch_id")).first()[0]
    open_ = spark.read.parquet(os.path.join(out_dir, "open", f"batch_id={last}"))
    return closed.drop("batch_id").unionByName(fold_sessions(with_sessions(open_, gap), cfg, gap))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove one of this module's own intermediate folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


FLAG_COLS = ("harsh_brake", "harsh_accel", "sharp_corner", "phone_raw", "speeding")


def event_counts(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG, window: str = "1 minute",
                 slide: str | None = None) -> DataFrame:
    """X3 on a batch: E1-E6 counts per tumbling (or sliding) window."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return detect_events(readings, cfg).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("readings"), *[F.sum(c).cast("long").alias(c) for c in FLAG_COLS],
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "readings", *FLAG_COLS)


def stream_event_counts(readings: DataFrame, out_dir: str, cfg: ProcessingConfig = DEFAULT_CONFIG, window: str = "1 minute",
                        slide: str | None = None) -> DataFrame:
    """E1-E6 counts per window over all that has come so far. A micro-batch lands its
    own counts, one row per window it touches; windows add up on reading, so late
    readings count too and the query may go on in the same ``out_dir`` at any time."""
    parts = run_partials(readings, lambda batch: event_counts(batch, cfg, window, slide), out_dir)
    return parts.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in ("readings", *FLAG_COLS)])


def stream_score(scored_stream: DataFrame) -> DataFrame:
    """Stateless per-row scoring on a stream."""
    return score_predictions(scored_stream, ids=("driver_id", "trip_id", "trip_date"))


def window_statistics(preds: DataFrame, time_col: str = "trip_date", window: str = "30 days") -> DataFrame:
    """Counts and sums of predictions per event-time window; they add up over batches."""
    p, s = F.col("claim_probability"), F.col("claim_severity_prediction")
    return preds.groupBy(F.window(time_col, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("n_p"), F.sum(p).alias("sum_p"),
        F.sum((p > 0.5).cast("long")).alias("high"), F.count(s).alias("n_s"), F.sum(s).alias("sum_s"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "n_p", "sum_p", "high", "n_s", "sum_s")


def stream_monitor(preds: DataFrame, baseline: DataFrame, out_dir: str, time_col: str = "trip_date",
                   window: str = "30 days") -> DataFrame:
    """R8 per event-time window against a static 1-row baseline (broadcast), over all
    predictions that have come so far (as `stream_event_counts`)."""
    parts = run_partials(preds, lambda batch: window_statistics(batch, time_col, window), out_dir)
    g = parts.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in ("n", "n_p", "sum_p", "high", "n_s", "sum_s")])
    p, s = F.try_divide("sum_p", "n_p"), F.try_divide("sum_s", "n_s")
    drift = lambda now, base: F.try_divide(F.abs(now - F.col(base)), F.col(base))
    return g.crossJoin(F.broadcast(baseline)).select(
        "window_start", "window_end", F.col("n").alias("total_predictions"), p.alias("avg_claim_probability"),
        F.try_divide("high", "n_p").alias("high_risk_ratio"), s.alias("avg_severity"),
        drift(p, "claim_probability_mean").alias("claim_probability_drift"), drift(s, "severity_mean").alias("severity_drift"))


def _run(df: DataFrame, land: Callable[[DataFrame, int], None], out_dir: str) -> None:
    """Run a query over all input there is (availableNow), checkpoint in ``out_dir``."""
    q = (df.writeStream.foreachBatch(land).option("checkpointLocation", os.path.join(out_dir, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_partials(df: DataFrame, fold: Callable[[DataFrame], DataFrame], out_dir: str) -> DataFrame:
    """Each micro-batch, folded, in its own batch_id folder (a replayed batch after a
    failure rewrites the same files); returns all of them."""
    data = os.path.join(out_dir, "data")
    _run(df, lambda batch, n: fold(batch).write.mode("overwrite").parquet(os.path.join(data, f"batch_id={n}")), out_dir)
    if not _exists(df.sparkSession, data):  # no input yet
        return fold(df.sparkSession.createDataFrame([], df.schema)).withColumn("batch_id", F.lit(0))
    return df.sparkSession.read.parquet(data)


def run_foreach_batch(df: DataFrame, out_dir: str) -> DataFrame:
    """Idempotent micro-batch sink: rows as they are, a folder per batch."""
    return run_partials(df, lambda batch: batch, out_dir)


def read_records(records: DataFrame, schema: T.StructType, watermark: str = "10 minutes") -> DataFrame:
    """X1, record form: rows as a message broker's reader gives them (key, value, topic,
    partition, offset, timestamp), with JSON values -> their fields. A record that is
    delivered again (same topic, partition, offset, within the watermark) counts
    once; a value that doesn't parse gives a row of nulls but its record columns."""
    d = records.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["topic", "partition", "offset"]) \
        if records.isStreaming else records.dropDuplicates(["topic", "partition", "offset"])
    return d.select(F.col("key").cast("string").alias("record_key"), "topic", "partition", "offset", F.col("timestamp").alias("record_time"),
                    F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("v")) \
        .select("record_key", "topic", "partition", "offset", "record_time", "v.*")
