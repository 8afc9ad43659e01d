"""E1-E7 event flags, W1 phone debounce, W2/N7-N10 path helpers on readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, ProcessingConfig
from ..functions.ordered import ordered_lags
from ..functions.scalar import accel_magnitude, bearing_degrees, flag, haversine_miles


def thresholds(cfg: ProcessingConfig = DEFAULT_CONFIG) -> dict:
    s = cfg.sensors
    if s.absolute_accel is not None:
        a = float(s.absolute_accel)
        return {"brake": -a, "accel": a, "corner": a}
    return {
        "brake": -s.harsh_braking_g * s.g_force,
        "accel": s.harsh_acceleration_g * s.g_force,
        "corner": s.sharp_cornering_g * s.g_force,
    }


def detect_events(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG) -> DataFrame:
    """E1-E4, E6 (and E7 through a config profile): 0/1 int flags per reading."""
    t = thresholds(cfg)
    s = cfg.sensors
    phone = F.col("screen_on") == 1
    if s.phone_app_pattern:
        phone = phone | F.coalesce(F.col("app_foreground").rlike(f"(?i){s.phone_app_pattern}"), F.lit(False))
    return readings.select(
        "*",
        flag(F.col("accelerometer_x") < t["brake"]).alias("harsh_brake"),
        flag(F.col("accelerometer_x") > t["accel"]).alias("harsh_accel"),
        flag(F.abs("accelerometer_y") > t["corner"]).alias("sharp_corner"),
        flag(phone).alias("phone_raw"),
        flag(F.col("speed_mph") > s.speed_limit_mph + s.speeding_buffer_mph).alias("speeding"),
    )


def debounce_phone(flags: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG,
                   key: str = "trip_key", seq: str = "reading_seq") -> DataFrame:
    """phone_use = 1 when the last `min_duration` rows (this one
    included, in reading order) all had phone_raw = 1; the first
    min_duration - 1 rows of a trip can never qualify (min_periods=1 sum)."""
    n = cfg.sensors.phone_use_min_duration_sec
    if n <= 1:
        return flags.withColumn("phone_use", F.col("phone_raw"))
    d = ordered_lags(flags, [key], seq, ["phone_raw"], n - 1, cfg.order_bucket_width)
    cond = F.col("phone_raw") == 1
    for j in range(1, n):
        cond = cond & F.coalesce(F.col(f"phone_raw_lag{j}") == 1, F.lit(False))
    return d.withColumn("phone_use", flag(cond)).drop(*[f"phone_raw_lag{j}" for j in range(1, n)])


def with_events(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG) -> DataFrame:
    """E1-E6 plus the debounced phone flag."""
    return debounce_phone(detect_events(readings, cfg), cfg)


def path_segments(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG,
                  key: str = "trip_key", seq: str = "reading_seq") -> DataFrame:
    """W2 + N8/N9: per reading, haversine miles and bearing from the previous
    reading of the same trip (NULL on the first reading)."""
    d = ordered_lags(readings, [key], seq, ["gps_latitude", "gps_longitude"], 1, cfg.order_bucket_width)
    plat, plon = F.col("gps_latitude_lag1"), F.col("gps_longitude_lag1")
    return d.select(
        *readings.columns,
        haversine_miles(plat, plon, "gps_latitude", "gps_longitude").alias("segment_miles"),
        bearing_degrees(plat, plon, "gps_latitude", "gps_longitude").alias("bearing_deg"),
    )


def trip_path_length(readings: DataFrame, cfg: ProcessingConfig = DEFAULT_CONFIG,
                     key: str = "trip_key") -> DataFrame:
    """Sum of point-to-point haversine distances per trip."""
    return (path_segments(readings, cfg, key=key)
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_points"),
                 F.coalesce(F.sum("segment_miles"), F.lit(0.0)).alias("path_miles")))


def derived_motion(readings: DataFrame) -> DataFrame:
    """Speed from m/s when present and the gravity-free acceleration magnitude."""
    cols = readings.columns
    speed = F.col("speed_ms") * 2.237 if "speed_ms" in cols else F.lit(None).cast("double")
    return readings.select(
        "*",
        speed.alias("speed_mph_from_ms"),
        accel_magnitude("accelerometer_x", "accelerometer_y", "accelerometer_z").alias("acceleration_magnitude"),
    )
