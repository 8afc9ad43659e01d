"""Frozen configuration for every operator.

All operators take a config object as a keyword argument, so a caller can
tune thresholds without touching code. Values are plain data; nothing here
creates a Spark session.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Sensor thresholds (in g), speeding buffer, debounce length, quality gates,
# time-of-day bins (start hour inclusive, end hour exclusive; night wraps),
# the id hash salt and the zone precision.
# ---------------------------------------------------------------------------
G_FORCE = 9.81
HARSH_BRAKING_G = 0.3
HARSH_ACCELERATION_G = 0.3
SHARP_CORNERING_G = 0.3
SPEEDING_BUFFER_MPH = 5.0
SPEED_LIMIT_MPH = 65.0
PHONE_USE_MIN_DURATION_SEC = 3
PHONE_APP_PATTERN = "phone|message|whatsapp"

MIN_GPS_ACCURACY_METERS = 50.0
MIN_DATA_COMPLETENESS = 0.8
MIN_TRIP_DURATION_MINUTES = 1.0
MAX_SPEED_MPH = 150.0

SPEED_BINS = (0, 25, 45, 65, 85, 150)
TIME_OF_DAY_BINS = (
    ("early_morning", 5, 7),
    ("morning_commute", 7, 9),
    ("midday", 9, 16),
    ("evening_commute", 16, 19),
    ("evening", 19, 22),
    ("night", 22, 5),
)
NIGHT_START_HOUR_LT = 6  # night trip: start hour < 6 or > 20
NIGHT_START_HOUR_GT = 20
RUSH_HOURS = (7, 8, 17, 18)

HASH_SALT = "telematics_2025"
LOCATION_PRECISION = 2
DEGREE_TO_MILES = 69.0
MIN_DISTANCE_MILES = 0.1
EARTH_RADIUS_MILES = 3959.0
BEARING_PI = 3.14159

# Default values for reading columns that are absent from a document.
READING_DEFAULTS = (
    ("gps_latitude", 0.0),
    ("gps_longitude", 0.0),
    ("gps_accuracy_meters", 20.0),
    ("speed_mph", 0.0),
    ("accelerometer_x", 0.0),
    ("accelerometer_y", 0.0),
    ("accelerometer_z", 9.81),
    ("screen_on", 0),
    ("app_foreground", "unknown"),
)
SYNTHETIC_START = "2024-01-01 00:00:00"
MS_TO_MPH = 2.237
KM_PER_MILE = 1.609344

# Scoring (risk score weights, severity cap, risk category cut points).
RISK_SCORE_P_WEIGHT = 0.6
RISK_SCORE_SEV_WEIGHT = 0.4
SEVERITY_CAP = 50000.0
RISK_CATEGORY_EDGES = (0.1, 0.25, 0.5, 0.75)
RISK_CATEGORY_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")
HIGH_RISK_PROBABILITY = 0.5
SEVERITY_NOISE_STD = 0.1  # severity uncertainty: 90 of 100 draws carry 10 % noise


@dataclass(frozen=True)
class SensorThresholds:
    harsh_braking_g: float = HARSH_BRAKING_G
    harsh_acceleration_g: float = HARSH_ACCELERATION_G
    sharp_cornering_g: float = SHARP_CORNERING_G
    speeding_buffer_mph: float = SPEEDING_BUFFER_MPH
    speed_limit_mph: float = SPEED_LIMIT_MPH
    phone_use_min_duration_sec: int = PHONE_USE_MIN_DURATION_SEC
    phone_app_pattern: str | None = PHONE_APP_PATTERN
    g_force: float = G_FORCE
    # Absolute thresholds (m/s^2) override the g-multiples when set; the
    # simple ETL profile uses +-2.94 and screen_on alone for phone use.
    absolute_accel: float | None = None


@dataclass(frozen=True)
class QualityThresholds:
    min_gps_accuracy_meters: float = MIN_GPS_ACCURACY_METERS
    min_data_completeness: float = MIN_DATA_COMPLETENESS
    min_trip_duration_minutes: float = MIN_TRIP_DURATION_MINUTES
    max_speed_mph: float = MAX_SPEED_MPH


@dataclass(frozen=True)
class ProcessingConfig:
    sensors: SensorThresholds = field(default_factory=SensorThresholds)
    quality: QualityThresholds = field(default_factory=QualityThresholds)
    time_of_day_bins: tuple = TIME_OF_DAY_BINS
    hash_salt: str = HASH_SALT
    location_precision: int = LOCATION_PRECISION
    # Rows per ordered sub-group for skew-safe row windows (see
    # functions/ordered.py). One trip with billions of readings is split
    # into buckets of this many sequence numbers.
    order_bucket_width: int = 1 << 20

    def with_quality(self, **kw) -> "ProcessingConfig":
        return replace(self, quality=replace(self.quality, **kw))

    def with_sensors(self, **kw) -> "ProcessingConfig":
        return replace(self, sensors=replace(self.sensors, **kw))


DEFAULT_CONFIG = ProcessingConfig()

# Simple ETL variant: fixed +-2.94 m/s^2, phone = screen_on, speeding > 65.
SIMPLE_ETL_CONFIG = ProcessingConfig(
    sensors=SensorThresholds(
        speeding_buffer_mph=0.0,
        phone_use_min_duration_sec=1,
        phone_app_pattern=None,
        absolute_accel=2.94,
    )
)

# Profile used when the operators run on the driver's `events` table: its
# readings are minutes-to-hours apart, so completeness is tiny by design.
TESTDATA_CONFIG = DEFAULT_CONFIG.with_quality(min_data_completeness=2e-5)
