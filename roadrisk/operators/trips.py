"""Readings -> quality-checked, anonymised trip summaries.

One ``groupBy(trip_key)`` folds all readings of a trip; every aggregate is
algebraic (count/sum/avg/min/max/min_by/max_by), so Spark pre-aggregates
map-side and a trip with a third of all readings only ships one partial row
per task. First/last-row fields use ``min_by/max_by(reading_seq)`` — exact
and deterministic, unlike ``first/last``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_CONFIG, ProcessingConfig
from ..functions.scalar import flag, hash_id, location_zone, time_of_day
from .events import with_events

ISSUE_CODES = ("poor_gps_accuracy", "incomplete_data", "trip_too_short", "unrealistic_speed")


def fold_trips(flagged: DataFrame, key: str = "trip_key") -> DataFrame:
    """The per-trip aggregate behind A1 and F1-F5 (flags must be present)."""
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.avg("gps_accuracy_meters").alias("gps_accuracy_avg"),
        F.avg("speed_mph").alias("average_speed_mph"),
        F.max("speed_mph").alias("max_speed_mph"),
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


def with_quality(folded: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Quality measures, one 0/1 column per failed check, an issue list."""
    q = cfg.quality
    span = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    d = folded.withColumn("span_seconds", span)
    d = d.withColumn(
        "completeness",
        F.when(F.col("span_seconds") > 0, F.col("n_readings") / F.col("span_seconds")).otherwise(F.lit(0.0)),
    ).withColumn("duration_minutes", F.col("span_seconds") / 60)
    checks = {
        "poor_gps_accuracy": F.col("gps_accuracy_avg") > q.min_gps_accuracy_meters,
        "incomplete_data": F.col("completeness") < q.min_data_completeness,
        "trip_too_short": F.col("duration_minutes") < q.min_trip_duration_minutes,
        "unrealistic_speed": F.col("max_speed_mph") > q.max_speed_mph,
    }
    for code, cond in checks.items():
        d = d.withColumn(f"fail_{code}", flag(cond))
    issues = F.array_compact(F.array(*[F.when(F.col(f"fail_{c}") == 1, F.lit(c)) for c in ISSUE_CODES]))
    return d.withColumn("issues", F.concat_ws(",", issues)).withColumn(
        "is_valid", flag(F.size(issues) == 0)
    )


def summary_columns(d: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG, extra: tuple = ()) -> DataFrame:
    """The 16 trip-summary columns (privacy transforms applied)."""
    start_hour = F.hour("start_time")
    dist = F.sqrt(F.pow(F.col("lat_max") - F.col("lat_min"), 2) + F.pow(F.col("lon_max") - F.col("lon_min"), 2))
    return d.select(
        F.col("first.trip_id").alias("trip_id"),
        hash_id(F.col("first.device_id"), cfg.hash_salt).alias("driver_id"),
        "duration_minutes",
        F.greatest(dist * C.DEGREE_TO_MILES, F.lit(C.MIN_DISTANCE_MILES)).alias("distance_miles"),
        "average_speed_mph",
        "max_speed_mph",
        "harsh_braking_events",
        "harsh_acceleration_events",
        "sharp_cornering_events",
        "phone_usage_seconds",
        "speeding_percent",
        flag((start_hour < C.NIGHT_START_HOUR_LT) | (start_hour > C.NIGHT_START_HOUR_GT)).alias("night_driving"),
        flag(start_hour.isin(*C.RUSH_HOURS)).alias("rush_hour"),
        time_of_day(F.hour("first.timestamp"), cfg.time_of_day_bins).alias("time_of_day"),
        location_zone("first.gps_latitude", "first.gps_longitude", cfg.location_precision).alias("start_zone"),
        location_zone("last.gps_latitude", "last.gps_longitude", cfg.location_precision).alias("end_zone"),
        *extra,
    )


def trip_quality(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG, key: str = "trip_key") -> DataFrame:
    """F1-F5 report: one row per trip with measures, failed checks, issues."""
    d = with_quality(fold_trips(with_events(readings, cfg), key), cfg)
    return d.select(
        key, F.col("first.trip_id").alias("trip_id"), "n_readings", "gps_accuracy_avg", "completeness",
        "duration_minutes", "max_speed_mph", *[f"fail_{c}" for c in ISSUE_CODES], "issues", "is_valid",
    )


def summarize_trips(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG,
                    key: str = "trip_key") -> DataFrame:
    """A1: valid trips only, 16 columns (F6: invalid ones go to `trip_rejects`)."""
    d = with_quality(fold_trips(with_events(readings, cfg), key), cfg).filter("is_valid = 1")
    return summary_columns(d, cfg)


def trip_rejects(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG, key: str = "trip_key") -> DataFrame:
    """rejected trips with their issue codes (replaces the reference's log)."""
    return trip_quality(readings, cfg, key).filter("is_valid = 0")


def quality_metrics(readings: DataFrame, key: str = "trip_key") -> DataFrame:
    """per trip average GPS accuracy, completeness and speed std."""
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / F.lit(1e6)
    return readings.groupBy(key).agg(
        F.avg("gps_accuracy_meters").alias("avg_gps_accuracy"),
        F.try_divide(F.count(F.lit(1)), span).alias("data_completeness"),
        F.stddev_samp("speed_mph").alias("speed_std"),
    )


def privacy_projection(trip_rows: DataFrame) -> DataFrame:
    """Drop exact times and raw positions, keep categories and zones."""
    drop = [c for c in ("start_time", "end_time", "timestamp", "gps_latitude", "gps_longitude", "device_id")
            if c in trip_rows.columns]
    return trip_rows.drop(*drop)


def union_batches(batches: dict[str, DataFrame], source: str = "batch") -> DataFrame:
    """Batches of trips under each other, by column name; a column that a batch lacks is null
    there, ``source`` names the batch. No batch: an error."""
    if not batches:
        raise ValueError("no batches to unite")
    out = None
    for name, df in batches.items():
        d = df.withColumn(source, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
