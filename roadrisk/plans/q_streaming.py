"""Streaming queries (X1-X5): each runs a Structured Streaming query to
completion (availableNow) over the driver's files and returns all of its windows
or sessions, those still open among them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..config import TESTDATA_CONFIG
from ..operators.scoring import baseline_stats
from ..sources.tables import checkpoint_dir
from ..streaming import streams as X
from . import views
from .catalog import register, rounded
from .oracle_sql import rnd
from .oracle_views import READINGS, with_views
from .q_readings import FLAGS_SQL, FOLD_SQL, SUMMARY_SELECT, VALID
from .q_scoring import PRED_DOUBLES, PRED_SQL

ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, " \
                "o_orderdate timestamp_ntz, o_orderpriority string"


def _out(spark, name):
    base = checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def _readings_stream(spark, sf):
    return views.readings_from_events(X.stream_source(spark, os.path.join(sf, "events.parquet"), X.EVENTS_SCHEMA))


SESSIONS_SQL = "WITH " + READINGS.strip().replace("readings AS (", "src AS (", 1) + """,
numbered AS (
  SELECT *, sum(CAST(coalesce("timestamp" - before >= INTERVAL 1 DAY, true) AS INTEGER))
      OVER (PARTITION BY device_id ORDER BY "timestamp", reading_seq) AS session
  FROM (SELECT *, lag("timestamp") OVER (PARTITION BY device_id ORDER BY "timestamp", reading_seq) AS before FROM src)
),
readings AS (
  SELECT * REPLACE (device_id || '#' || CAST(session AS VARCHAR) AS trip_key) FROM numbered
)"""


@register("stream_trip_summary", SESSIONS_SQL + "," + FLAGS_SQL + "," + FOLD_SQL + SUMMARY_SELECT.replace(
    "FROM chk", ", start_time AS session_start, end_time + INTERVAL 1 DAY AS session_end FROM chk") + f"\nWHERE {VALID} = 0")
def q_stream_trip_summary(spark, sf):
    """Device sessions (1 day silence gap on this data) -> trip summaries."""
    return rounded(X.stream_trip_summary(_readings_stream(spark, sf), _out(spark, "trip_summary"), TESTDATA_CONFIG,
                                         gap="1 day", watermark="1 day"))


@register("stream_event_counts", with_views("readings") + "," + FLAGS_SQL + """
SELECT date_trunc('hour', "timestamp") AS window_start, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
  count(*) AS readings, CAST(sum(harsh_brake) AS BIGINT) AS harsh_brake, CAST(sum(harsh_accel) AS BIGINT) AS harsh_accel,
  CAST(sum(sharp_corner) AS BIGINT) AS sharp_corner, CAST(sum(phone_raw) AS BIGINT) AS phone_raw,
  CAST(sum(speeding) AS BIGINT) AS speeding
FROM flags GROUP BY 1, 2""")
def q_stream_event_counts(spark, sf):
    """Event counts per 1-hour tumbling window."""
    return X.stream_event_counts(_readings_stream(spark, sf), _out(spark, "event_counts"), TESTDATA_CONFIG, window="1 hour")


@register("stream_event_counts_sliding", with_views("readings") + "," + FLAGS_SQL + """,
k AS (SELECT unnest([0, 1, 2, 3]) AS back),
w AS (
  SELECT time_bucket(INTERVAL 15 MINUTES, "timestamp", TIMESTAMP '1970-01-01') - back * INTERVAL 15 MINUTES AS window_start, flags.*
  FROM flags CROSS JOIN k
)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end,
  count(*) AS readings, CAST(sum(harsh_brake) AS BIGINT) AS harsh_brake, CAST(sum(harsh_accel) AS BIGINT) AS harsh_accel,
  CAST(sum(sharp_corner) AS BIGINT) AS sharp_corner, CAST(sum(phone_raw) AS BIGINT) AS phone_raw,
  CAST(sum(speeding) AS BIGINT) AS speeding
FROM w GROUP BY 1, 2""")
def q_stream_event_counts_sliding(spark, sf):
    """Event counts per hour, a window every 15 minutes."""
    return X.stream_event_counts(_readings_stream(spark, sf), _out(spark, "event_counts_sliding"), TESTDATA_CONFIG,
                                 window="1 hour", slide="15 minutes")


@register("stream_score", rnd(with_views("scored") + "," + PRED_SQL + """
SELECT pred.*, scored.trip_date FROM pred JOIN scored USING (trip_id)""", PRED_DOUBLES))
def q_stream_score(spark, sf):
    """Orders arrive as a stream, join the static lineitem aggregate and
    customer (stream-static joins), are scored per row; idempotent
    foreachBatch sink."""
    o = X.stream_source(spark, os.path.join(sf, "orders.parquet"), spark.createDataFrame([], ORDERS_SCHEMA).schema)
    s = X.stream_score(views.scored(spark, sf, orders=o))
    return rounded(X.run_foreach_batch(s, _out(spark, "score")).drop("batch_id"))


@register("stream_monitor", rnd(with_views("scored") + """,
base AS (SELECT avg(claim_probability) AS p, avg(claim_severity_prediction) AS s FROM scored),
g AS (
  SELECT time_bucket(INTERVAL 30 DAYS, CAST(trip_date AS TIMESTAMP), TIMESTAMP '1970-01-01') AS window_start,
    count(*) AS total_predictions, avg(claim_probability) AS avg_claim_probability,
    avg(CAST(claim_probability > 0.5 AS INTEGER)) AS high_risk_ratio, avg(claim_severity_prediction) AS avg_severity
  FROM scored GROUP BY 1
)
SELECT window_start, window_start + INTERVAL 30 DAYS AS window_end, total_predictions, avg_claim_probability,
  high_risk_ratio, avg_severity, abs(avg_claim_probability - p) / p AS claim_probability_drift,
  abs(avg_severity - s) / s AS severity_drift
FROM g CROSS JOIN base""", ["avg_claim_probability", "high_risk_ratio", "avg_severity", "claim_probability_drift",
                            "severity_drift"]))
def q_stream_monitor(spark, sf):
    """30-day windowed monitoring of streamed predictions vs the batch baseline."""
    o = X.stream_source(spark, os.path.join(sf, "orders.parquet"), spark.createDataFrame([], ORDERS_SCHEMA).schema)
    pred = views.scored(spark, sf, orders=o)
    base = baseline_stats(views.scored(spark, sf))
    return rounded(X.stream_monitor(pred, base, _out(spark, "monitor")))
