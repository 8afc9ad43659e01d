"""JSON ingestion queries (S1-S4, N1-N6): the readings are written as raw
documents of every shape and defect into the shared folder, one a line, and
read back by the loader; the SQL side applies the rules to the table itself.

The trip number mod 6 picks the shape: 0 list with a trip document, 1 list of
readings without times, 2 trip document, 3 document with ``readings`` that
lack device and accuracy and hold booleans, 4 one flat document a reading,
5 documents that can't be parsed. Some speeds are quoted, null, garbage or
"NaN"; some trips hold a bad time. Every fifth trip of shape 2 has the accuracy
null throughout (0, not the default), every fifth of shape 0 has the app in its
metadata alone; metadata names an app and a scenario besides.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import TESTDATA_CONFIG
from ..operators import trips as TR
from ..sources.readings_json import read_raw_documents, read_readings_json, rejected_documents
from ..sources.tables import checkpoint_dir
from . import views
from .catalog import lit, register, rounded
from .oracle_views import READINGS
from .q_readings import FLAGS_SQL, FOLD_SQL, SUMMARY_SELECT, VALID

COLUMNS = ("trip_id", "reading_seq", "timestamp", "device_id", "gps_latitude", "gps_longitude", "gps_accuracy_meters",
           "speed_mph", "accelerometer_x", "accelerometer_y", "accelerometer_z", "screen_on", "app_foreground")


def documents(r: DataFrame) -> DataFrame:
    """Readings -> (value): JSON documents, one per trip (shape 4: per reading)."""
    shape, n = F.col("trip_key") % 6, F.col("reading_seq")

    def field(name, value):  # a member of a JSON object: {"name":value} without its braces
        return F.expr(f"regexp_extract(to_json(struct({value} AS {name})), '^.(.*).$', 1)")

    speed = (F.when(n % 13 == 0, F.lit('"speed_mph":null'))
             .when(n % 17 == 0, F.lit('"speed_mph":"garbage"'))
             .when(n % 19 == 0, F.lit('"speed_mph":"NaN"'))
             .when(n % 11 == 0, field("speed_mph", "cast(speed_mph AS string)"))
             .otherwise(field("speed_mph", "speed_mph")))
    bad_time = (shape == 2) & (F.col("trip_key") % 7 == 3)
    time = F.when(bad_time, F.lit('"timestamp":"not a time"')).otherwise(
        field("timestamp", "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"))
    trip = F.when(shape == 4, F.concat(F.lit('"trip_id":"e'), n.cast("string"), F.lit('"'))).otherwise(
        field("trip_id", "concat('t', trip_key)"))
    parts = [
        F.when(shape.isin(1, 3, 4), trip),
        F.when(shape.isin(1, 4), field("device_id", "device_id")),
        F.when(shape != 1, time),
        F.when((shape == 2) & (F.col("trip_key") % 5 == 1), F.lit('"gps_accuracy_meters":null'))
        .when(shape != 3, field("gps_accuracy_meters", "gps_accuracy_meters")),
        F.when(shape == 3, field("screen_on", "screen_on = 1")).otherwise(field("screen_on", "screen_on")),
        F.when(shape == 0, field("speed_ms", "speed_mph / 4")),
        speed,
        *[field(c, c) for c in ("gps_latitude", "gps_longitude", "accelerometer_x", "accelerometer_y", "accelerometer_z")],
        F.when((shape != 0) | (F.col("trip_key") % 5 != 2), field("app_foreground", "app_foreground")),
    ]
    one = r.select("trip_key", "reading_seq", "device_id", shape.alias("shape"),
                   F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("doc"))
    flat = one.filter("shape = 4").select(F.col("doc").alias("value"))
    # a document holds its whole trip, as the source files do
    trips = one.filter("shape <> 4").groupBy("trip_key", "shape", "device_id").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("reading_seq", "doc"))), lambda x: x["doc"]))
        .alias("list"))
    meta = F.format_string(
        '{"trip_metadata":{"trip_id":"t%d","device_id":"%s","scenario":"s%d","app_foreground":"com.trip"},"sensor_readings":[%s]}',
        "trip_key", "device_id", "trip_key", "list")
    value = (F.when(F.col("shape") == 0, F.concat(F.lit("["), meta, F.lit("]")))
             .when(F.col("shape") == 1, F.concat(F.lit("["), F.col("list"), F.lit("]")))
             .when(F.col("shape") == 2, meta)
             .when(F.col("shape") == 3, F.concat(F.lit('{"readings":['), F.col("list"), F.lit("]}")))
             .when(F.col("trip_key") % 4 == 1, F.format_string('{"trip_id":"t%d","readings":[{"speed_mph":1', "trip_key"))
             .otherwise(F.format_string("not json %d", "trip_key")))
    return trips.select(value.alias("value")).unionByName(flat)


def landed(spark: SparkSession, sf: str) -> str:
    path = os.path.join(checkpoint_dir(spark), "json", uuid.uuid4().hex)
    documents(views.readings(spark, sf)).write.text(path)
    return path


JSON_SQL = "WITH " + READINGS.strip().replace("readings AS (", "src AS (", 1) + f""",
numbered AS (
  SELECT *, trip_key % 6 AS shape, row_number() OVER (PARTITION BY trip_key ORDER BY reading_seq) - 1 AS seq FROM src
),
readings AS (
  SELECT
    CASE WHEN shape = 4 THEN 'e' || CAST(reading_seq AS VARCHAR) ELSE 't' || CAST(trip_key AS VARCHAR) END AS trip_key,
    CASE WHEN shape = 4 THEN 'e' || CAST(reading_seq AS VARCHAR) ELSE 't' || CAST(trip_key AS VARCHAR) END AS trip_id,
    CASE WHEN shape = 4 THEN 0 ELSE seq END AS reading_seq,
    CASE WHEN shape = 1 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(seq AS BIGINT)) ELSE "timestamp" END AS "timestamp",
    CASE WHEN shape = 3 THEN 'unknown_device' ELSE device_id END AS device_id,
    gps_latitude, gps_longitude,
    CASE WHEN shape = 3 THEN 20.0 WHEN shape = 2 AND trip_key % 5 = 1 THEN 0.0 ELSE gps_accuracy_meters END AS gps_accuracy_meters,
    CASE WHEN shape = 0 THEN speed_mph / 4 * {lit(C.MS_TO_MPH)}
         WHEN reading_seq % 13 = 0 OR reading_seq % 17 = 0 OR reading_seq % 19 = 0 THEN 0.0 ELSE speed_mph END AS speed_mph,
    accelerometer_x, accelerometer_y, accelerometer_z, screen_on,
    CASE WHEN shape = 0 AND trip_key % 5 = 2 THEN 'com.trip' ELSE app_foreground END AS app_foreground,
    CASE WHEN shape IN (0, 2) THEN 's' || CAST(trip_key AS VARCHAR) END AS scenario
  FROM numbered WHERE shape <> 5 AND NOT (shape = 2 AND trip_key % 7 = 3)
)"""


@register("json_readings", JSON_SQL + f"""
SELECT {', '.join('"timestamp"' if c == 'timestamp' else
                  f'(floor(({c}) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS {c}'
                  if c.startswith(('gps', 'speed', 'acc')) else c for c in COLUMNS)}, scenario FROM readings""")
def q_json_readings(spark, sf):
    """Raw documents -> normalised readings, every shape and defect."""
    r = read_readings_json(spark, landed(spark, sf), "*.txt", json_lines=True, convert_speed_ms=True)
    return rounded(r.select(*COLUMNS, F.col("metadata")["scenario"].alias("scenario")))


@register("json_trip_summary", JSON_SQL + "," + FLAGS_SQL + "," + FOLD_SQL + SUMMARY_SELECT + f"\nWHERE {VALID} = 0")
def q_json_trip_summary(spark, sf):
    """The loader's whole path: raw documents -> quality-gated trip summaries."""
    r = read_readings_json(spark, landed(spark, sf), "*.txt", json_lines=True, convert_speed_ms=True)
    return rounded(TR.summarize_trips(r, TESTDATA_CONFIG))


@register("json_rejects", "WITH " + READINGS.strip() + """
SELECT CASE WHEN trip_key % 4 = 1 THEN '{"trip_id":"t' || CAST(trip_key AS VARCHAR) || '","readings":[{"speed_mph":1'
            ELSE 'not json ' || CAST(trip_key AS VARCHAR) END AS value
FROM readings WHERE trip_key % 6 = 5 GROUP BY trip_key""")
def q_json_rejects(spark, sf):
    """Documents that can't be parsed, routed apart."""
    return rejected_documents(read_raw_documents(spark, landed(spark, sf), "*.txt", json_lines=True)).select("value")
