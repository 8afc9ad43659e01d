"""Readings -> trips queries (E*, W1, W2, N*, F1-F7, A*) on the `readings` view."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from .. import config as C
from ..config import SIMPLE_ETL_CONFIG, TESTDATA_CONFIG
from ..functions.scalar import hash_id, location_zone, time_of_day
from ..operators import events as E
from ..operators import trips as TR
from . import views
from .catalog import lit, register, rounded
from .oracle_views import with_views

CFG = TESTDATA_CONFIG
TH = E.thresholds(CFG)
SPEED = CFG.sensors.speed_limit_mph + CFG.sensors.speeding_buffer_mph

FLAGS_SQL = f"""
flags AS (
  SELECT *,
    CAST(accelerometer_x < {lit(TH['brake'])} AS INTEGER) AS harsh_brake,
    CAST(accelerometer_x > {lit(TH['accel'])} AS INTEGER) AS harsh_accel,
    CAST(abs(accelerometer_y) > {lit(TH['corner'])} AS INTEGER) AS sharp_corner,
    CAST(screen_on = 1 OR coalesce(regexp_matches(app_foreground, '{C.PHONE_APP_PATTERN}', 'i'), false) AS INTEGER)
      AS phone_raw,
    CAST(speed_mph > {lit(SPEED)} AS INTEGER) AS speeding
  FROM readings
),
deb AS (
  SELECT *, CAST(sum(phone_raw) OVER (PARTITION BY trip_key ORDER BY reading_seq
                                      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS INTEGER) AS phone_use
  FROM flags
)"""

FOLD_SQL = f"""
fold AS (
  SELECT trip_key, count(*) AS n_readings, min("timestamp") AS start_time, max("timestamp") AS end_time,
    avg(gps_accuracy_meters) AS gps_accuracy_avg, avg(speed_mph) AS average_speed_mph,
    max(speed_mph) AS max_speed_mph,
    min(gps_latitude) AS lat_min, max(gps_latitude) AS lat_max,
    min(gps_longitude) AS lon_min, max(gps_longitude) AS lon_max,
    CAST(sum(harsh_brake) AS BIGINT) AS harsh_braking_events,
    CAST(sum(harsh_accel) AS BIGINT) AS harsh_acceleration_events,
    CAST(sum(sharp_corner) AS BIGINT) AS sharp_cornering_events,
    CAST(sum(phone_use) AS BIGINT) AS phone_usage_seconds,
    avg(speeding) AS speeding_percent,
    arg_min(trip_id, reading_seq) AS first_trip_id, arg_min(device_id, reading_seq) AS first_device_id,
    arg_min(gps_latitude, reading_seq) AS first_lat, arg_min(gps_longitude, reading_seq) AS first_lon,
    arg_min("timestamp", reading_seq) AS first_ts,
    arg_max(gps_latitude, reading_seq) AS last_lat, arg_max(gps_longitude, reading_seq) AS last_lon
  FROM deb GROUP BY trip_key
),
spans AS (
  SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS span_seconds FROM fold
),
qual AS (
  SELECT *,
    CASE WHEN span_seconds > 0 THEN n_readings / span_seconds ELSE 0.0 END AS completeness,
    span_seconds / 60 AS duration_minutes
  FROM spans
),
chk AS (
  SELECT *,
    CAST(gps_accuracy_avg > {lit(CFG.quality.min_gps_accuracy_meters)} AS INTEGER) AS fail_poor_gps_accuracy,
    CAST(completeness < {lit(CFG.quality.min_data_completeness)} AS INTEGER) AS fail_incomplete_data,
    CAST(duration_minutes < {lit(CFG.quality.min_trip_duration_minutes)} AS INTEGER) AS fail_trip_too_short,
    CAST(max_speed_mph > {lit(CFG.quality.max_speed_mph)} AS INTEGER) AS fail_unrealistic_speed
  FROM qual
)"""

TOD_SQL = """CASE
      WHEN {h} >= 5 AND {h} < 7 THEN 'early_morning'
      WHEN {h} >= 7 AND {h} < 9 THEN 'morning_commute'
      WHEN {h} >= 9 AND {h} < 16 THEN 'midday'
      WHEN {h} >= 16 AND {h} < 19 THEN 'evening_commute'
      WHEN {h} >= 19 AND {h} < 22 THEN 'evening'
      WHEN {h} >= 22 OR {h} < 5 THEN 'night'
      ELSE 'unknown' END"""

SUMMARY_SELECT = f"""
SELECT first_trip_id AS trip_id,
  substr(sha256(first_device_id || '{C.HASH_SALT}'), 1, 16) AS driver_id,
  (floor((duration_minutes) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS duration_minutes,
  (floor((greatest(sqrt(pow(lat_max - lat_min, 2) + pow(lon_max - lon_min, 2)) * 69.0, 0.1)) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS distance_miles,
  (floor((average_speed_mph) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS average_speed_mph, (floor((max_speed_mph) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS max_speed_mph,
  harsh_braking_events, harsh_acceleration_events, sharp_cornering_events, phone_usage_seconds,
  (floor((speeding_percent) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS speeding_percent,
  CAST(hour(start_time) < 6 OR hour(start_time) > 20 AS INTEGER) AS night_driving,
  CAST(hour(start_time) IN (7, 8, 17, 18) AS INTEGER) AS rush_hour,
  {TOD_SQL.format(h='hour(first_ts)')} AS time_of_day,
  'zone_' || CAST(round(first_lat, 2) AS VARCHAR) || '_' || CAST(round(first_lon, 2) AS VARCHAR) AS start_zone,
  'zone_' || CAST(round(last_lat, 2) AS VARCHAR) || '_' || CAST(round(last_lon, 2) AS VARCHAR) AS end_zone
FROM chk"""

VALID = ("fail_poor_gps_accuracy + fail_incomplete_data + fail_trip_too_short + fail_unrealistic_speed")

TRIP_SUMMARY_SQL = with_views("readings") + "," + FLAGS_SQL + "," + FOLD_SQL + SUMMARY_SELECT + f"\nWHERE {VALID} = 0"


@register("trip_summary", TRIP_SUMMARY_SQL)
def q_trip_summary(spark, sf):
    """A1 flagship: readings -> quality-gated, anonymised trip summaries."""
    return rounded(TR.summarize_trips(views.readings(spark, sf), CFG))


QUALITY_SQL = with_views("readings") + "," + FLAGS_SQL + "," + FOLD_SQL + f"""
SELECT trip_key, first_trip_id AS trip_id, n_readings,
  (floor((gps_accuracy_avg) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS gps_accuracy_avg, (floor((completeness) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS completeness,
  (floor((duration_minutes) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS duration_minutes, (floor((max_speed_mph) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS max_speed_mph,
  fail_poor_gps_accuracy, fail_incomplete_data, fail_trip_too_short, fail_unrealistic_speed,
  concat_ws(',', CASE WHEN fail_poor_gps_accuracy = 1 THEN 'poor_gps_accuracy' END,
                 CASE WHEN fail_incomplete_data = 1 THEN 'incomplete_data' END,
                 CASE WHEN fail_trip_too_short = 1 THEN 'trip_too_short' END,
                 CASE WHEN fail_unrealistic_speed = 1 THEN 'unrealistic_speed' END) AS issues,
  CAST({VALID} = 0 AS INTEGER) AS is_valid
FROM chk"""


@register("trip_quality_issues", QUALITY_SQL)
def q_trip_quality(spark, sf):
    """Every trip with its measures, failed checks and issue codes."""
    return rounded(TR.trip_quality(views.readings(spark, sf), CFG))


@register("trip_rejects", f"SELECT * FROM ({QUALITY_SQL}) WHERE is_valid = 0")
def q_trip_rejects(spark, sf):
    """rejected trips routed to their own table."""
    return rounded(TR.trip_rejects(views.readings(spark, sf), CFG))


EVENT_COLS = "trip_key, reading_seq, harsh_brake, harsh_accel, sharp_corner, phone_raw, speeding, phone_use"


@register("event_flags", with_views("readings") + "," + FLAGS_SQL + f"\nSELECT {EVENT_COLS} FROM deb")
def q_event_flags(spark, sf):
    """E1-E6 per reading, with the debounced phone flag."""
    d = E.with_events(views.readings(spark, sf), CFG)
    return d.select(*[c.strip() for c in EVENT_COLS.split(",")])


@register("phone_debounce", with_views("readings") + "," + FLAGS_SQL
          + "\nSELECT trip_key, reading_seq, phone_raw, phone_use FROM deb")
def q_phone_debounce(spark, sf):
    """W1 through the skew-split path: buckets of 4 sequence numbers, so
    nearly every debounce window crosses a bucket boundary and is patched
    from the carry table. Must equal the plain window."""
    cfg = dataclasses.replace(CFG, order_bucket_width=4)
    d = E.debounce_phone(E.detect_events(views.readings(spark, sf), cfg), cfg)
    return d.select("trip_key", "reading_seq", "phone_raw", "phone_use")


HAV = """(3959.0 * 2 * atan2(sqrt(pow(sin((radians(gps_latitude) - radians(plat)) / 2), 2)
      + cos(radians(plat)) * cos(radians(gps_latitude)) * pow(sin((radians(gps_longitude) - radians(plon)) / 2), 2)),
      sqrt(1 - (pow(sin((radians(gps_latitude) - radians(plat)) / 2), 2)
      + cos(radians(plat)) * cos(radians(gps_latitude)) * pow(sin((radians(gps_longitude) - radians(plon)) / 2), 2)))))"""
BEAR = """((atan2(sin(radians(gps_longitude) - radians(plon)) * cos(radians(gps_latitude)),
      cos(radians(plat)) * sin(radians(gps_latitude))
      - sin(radians(plat)) * cos(radians(gps_latitude)) * cos(radians(gps_longitude) - radians(plon)))
      * 180 / 3.14159 + 360) % 360)"""
SEG_SQL = """
seg AS (
  SELECT trip_key, reading_seq, gps_latitude, gps_longitude,
    lag(gps_latitude) OVER (PARTITION BY trip_key ORDER BY reading_seq) AS plat,
    lag(gps_longitude) OVER (PARTITION BY trip_key ORDER BY reading_seq) AS plon
  FROM readings
)"""


@register("trip_path_length", with_views("readings") + "," + SEG_SQL + f"""
SELECT trip_key, CAST(count(*) AS BIGINT) AS n_points, (floor((coalesce(sum({HAV}), 0.0)) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS path_miles
FROM seg GROUP BY trip_key""")
def q_trip_path_length(spark, sf):
    """Haversine path length per trip from consecutive readings."""
    return rounded(E.trip_path_length(views.readings(spark, sf), CFG))


@register("trip_bearing", with_views("readings") + "," + SEG_SQL + f"""
SELECT trip_key, reading_seq, (floor(({HAV}) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS segment_miles, (floor(({BEAR}) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS bearing_deg FROM seg""")
def q_trip_bearing(spark, sf):
    """Per reading distance and initial bearing from the previous point."""
    d = E.path_segments(views.readings(spark, sf), CFG)
    return rounded(d.select("trip_key", "reading_seq", "segment_miles", "bearing_deg"))


@register("id_hash_zone", with_views("readings") + f"""
SELECT device_id, substr(sha256(device_id || '{C.HASH_SALT}'), 1, 16) AS driver_id,
  CAST(count(DISTINCT 'zone_' || CAST(round(gps_latitude, 2) AS VARCHAR) || '_'
       || CAST(round(gps_longitude, 2) AS VARCHAR)) AS BIGINT) AS zones_visited
FROM readings GROUP BY device_id""")
def q_id_hash_zone(spark, sf):
    """Salted device hash and the number of distinct location zones."""
    r = views.readings(spark, sf)
    return r.groupBy("device_id").agg(
        F.first(hash_id("device_id")).alias("driver_id"),
        F.count_distinct(location_zone("gps_latitude", "gps_longitude")).alias("zones_visited"))


@register("time_of_day_category", with_views("readings") + f"""
SELECT hour("timestamp") AS hour, {TOD_SQL.format(h='hour("timestamp")')} AS time_of_day,
  CAST(count(*) AS BIGINT) AS readings
FROM readings GROUP BY 1, 2""")
def q_time_of_day(spark, sf):
    """Half-open hour bins (night wraps midnight) per reading hour."""
    r = views.readings(spark, sf)
    return r.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("readings")) \
        .select("hour", time_of_day("hour").alias("time_of_day"), "readings")


@register("quality_metrics", with_views("readings") + """
SELECT trip_key, (floor((avg(gps_accuracy_meters)) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS avg_gps_accuracy,
  (floor(CASE WHEN epoch_us(max("timestamp")) > epoch_us(min("timestamp"))
        THEN count(*) / ((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6) END * 1000000.0 + 0.5000076293945312)
        / 1000000.0) AS data_completeness,
  (floor((stddev_samp(speed_mph)) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS speed_std
FROM readings GROUP BY trip_key""")
def q_quality_metrics(spark, sf):
    """per-trip GPS accuracy, completeness and speed std."""
    return rounded(TR.quality_metrics(views.readings(spark, sf)))


@register("acceleration_magnitude", with_views("readings") + """
SELECT trip_key,
  (floor((max(sqrt(pow(accelerometer_x, 2) + pow(accelerometer_y, 2) + pow(accelerometer_z - 9.81, 2)))) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS max_magnitude,
  (floor((avg(sqrt(pow(accelerometer_x, 2) + pow(accelerometer_y, 2) + pow(accelerometer_z - 9.81, 2)))) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS avg_magnitude
FROM readings GROUP BY trip_key""")
def q_accel_magnitude(spark, sf):
    """Gravity-free acceleration magnitude per trip (max, mean)."""
    d = E.derived_motion(views.readings(spark, sf))
    return rounded(d.groupBy("trip_key").agg(F.max("acceleration_magnitude").alias("max_magnitude"),
                                             F.avg("acceleration_magnitude").alias("avg_magnitude")))


SIMPLE = dataclasses.replace(SIMPLE_ETL_CONFIG, quality=CFG.quality)
SIMPLE_FLAGS_SQL = FLAGS_SQL.replace(f"< {lit(TH['brake'])}", f"< {lit(-2.94)}") \
    .replace(f"> {lit(TH['accel'])}", f"> {lit(2.94)}").replace(f"> {lit(TH['corner'])}", f"> {lit(2.94)}") \
    .replace(f"CAST(screen_on = 1 OR coalesce(regexp_matches(app_foreground, '{C.PHONE_APP_PATTERN}', 'i'), false) AS INTEGER)",
             "CAST(screen_on = 1 AS INTEGER)") \
    .replace(f"speed_mph > {lit(SPEED)}", f"speed_mph > {lit(65.0)}") \
    .replace("CAST(sum(phone_raw) OVER (PARTITION BY trip_key ORDER BY reading_seq\n"
             "                                      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS INTEGER)",
             "phone_raw")


@register("simple_etl_summary",
          with_views("readings") + "," + SIMPLE_FLAGS_SQL + "," + FOLD_SQL + SUMMARY_SELECT + f"\nWHERE {VALID} = 0")
def q_simple_etl(spark, sf):
    """The simple ETL profile (+-2.94 m/s^2, phone = screen on, > 65 mph)."""
    return rounded(TR.summarize_trips(views.readings(spark, sf), SIMPLE))


@register("trips_sink_roundtrip", "SELECT time_of_day, count(*) AS trips, count(*) AS matching_rows FROM ("
          + TRIP_SUMMARY_SQL + ") AS s GROUP BY time_of_day")
def q_sink_roundtrip(spark, sf):
    """Trip summaries written as Parquet partitioned by time of day
    and as header CSV into the shared folder, all read back (the CSV with its
    explicit schema)."""
    import os
    import uuid

    from ..sources.tables import checkpoint_dir, read_trips_csv, write_table
    base = os.path.join(checkpoint_dir(spark), "sinks", uuid.uuid4().hex[:8])
    s = TR.summarize_trips(views.readings(spark, sf), CFG).withColumn("trip_id", F.col("trip_id").cast("string"))
    write_table(s, os.path.join(base, "parquet"), partition_by=["time_of_day"])
    write_table(s, os.path.join(base, "csv"), fmt="csv")
    pq = spark.read.parquet(os.path.join(base, "parquet"))
    csv = read_trips_csv(spark, os.path.join(base, "csv"))
    both = pq.select("trip_id", "driver_id", "time_of_day", "phone_usage_seconds").join(
        csv.select("trip_id", F.col("phone_usage_seconds").alias("csv_phone")), "trip_id")
    return both.groupBy("time_of_day").agg(F.count(F.lit(1)).alias("trips"),
                                           F.count_if(F.col("phone_usage_seconds") == F.col("csv_phone"))
                                           .alias("matching_rows"))


@register("privacy_projection", with_views("readings") + """
SELECT trip_key, trip_id, reading_seq, gps_accuracy_meters, speed_mph, accelerometer_x, accelerometer_y,
  accelerometer_z, screen_on, app_foreground,
  'zone_' || CAST(round(gps_latitude, 2) AS VARCHAR) || '_' || CAST(round(gps_longitude, 2) AS VARCHAR) AS zone,
  """ + TOD_SQL.format(h='hour("timestamp")') + """ AS time_of_day
FROM readings""")
def q_privacy(spark, sf):
    """Readings with exact time, position and device removed;
    the zone and time-of-day category kept."""
    r = views.readings(spark, sf)
    r = r.select("*", location_zone("gps_latitude", "gps_longitude").alias("zone"),
                 time_of_day(F.hour("timestamp")).alias("time_of_day"))
    return TR.privacy_projection(r)


@register("readings_normalize", with_views("readings") + """
SELECT trip_key, reading_seq, "timestamp", device_id, gps_latitude, gps_longitude, gps_accuracy_meters, speed_mph,
  accelerometer_x, accelerometer_y, accelerometer_z, screen_on, app_foreground FROM readings""")
def q_readings_normalize(spark, sf):
    """N1-N5 on the driver's events: the normalised reading table every
    reading operator consumes (typed, defaults applied, trip key and order)."""
    r = views.readings(spark, sf)
    return r.select("trip_key", "reading_seq", "timestamp", "device_id", "gps_latitude", "gps_longitude",
                    "gps_accuracy_meters", "speed_mph", "accelerometer_x", "accelerometer_y", "accelerometer_z",
                    "screen_on", "app_foreground")
