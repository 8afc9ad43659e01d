"""57-feature queries (T2-T12) and audits (F8-F10) on the `trips` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drivers as D
from ..operators import features as FE
from . import views
from .catalog import register, rounded
from .oracle_sql import rnd
from .oracle_views import with_views
from .q_drivers import BASIC_SQL

FEATURES_SQL = """
fb AS (
  SELECT trip_id, driver_id,
    trip_duration_minutes AS dur, trip_distance_km AS dist, max_speed_kmh AS mx, avg_speed_kmh AS av,
    hard_braking_count AS hb, hard_acceleration_count AS ha, sharp_turn_count AS st,
    night_driving_minutes AS night, rush_hour_minutes AS rush, phone_use_minutes AS phone,
    continuous_driving_hours AS cont, weekend_driving AS weekend,
    0.0 AS aw, 0.0 AS rain, 0.0 AS snow, 0.0 AS fog, 0.0 AS traffic,
    greatest(trip_distance_km, 0.1) AS rate_dist,
    greatest(trip_duration_minutes / 60, 0.01) AS hours,
    greatest(trip_duration_minutes, 1.0) AS total_dur
  FROM trip_inputs
),
f1 AS (
  SELECT trip_id, driver_id,
    dur AS trip_duration_minutes,
    dist AS trip_distance_km,
    CASE WHEN dur > 0 THEN dist / (dur / 60) ELSE 0.0 END AS avg_trip_speed,
    ln(1 + dur) AS log_trip_duration,
    ln(1 + dist) AS log_trip_distance,
    CASE WHEN dist > 0 THEN dur / dist ELSE 0.0 END AS trip_efficiency,
    mx AS max_speed_kmh,
    av AS avg_speed_kmh,
    CASE WHEN av > 0 THEN (mx - av) / av ELSE 0.0 END AS speed_variance,
    CAST(mx > 120 AS INTEGER) AS high_speed_indicator,
    CAST(mx > 140 AS INTEGER) AS very_high_speed_indicator,
    CASE WHEN mx > 0 THEN av / mx ELSE 0.0 END AS speed_consistency,
    greatest(0.0, (mx - 100) / 100) AS speeding_severity,
    hb AS hard_braking_count,
    ha AS hard_acceleration_count,
    st AS sharp_turn_count,
    hb + ha + st AS total_aggressive_events,
    hb / rate_dist AS hard_braking_rate,
    ha / rate_dist AS hard_acceleration_rate,
    (hb + ha + st) / rate_dist AS aggressive_events_rate,
    hb / hours AS hard_braking_per_hour,
    ha / hours AS hard_acceleration_per_hour,
    CAST(hb > 0 AS INTEGER) AS has_hard_braking,
    CAST(ha > 0 AS INTEGER) AS has_hard_acceleration,
    CAST(hb + ha + st > 0 AS INTEGER) AS has_aggressive_driving,
    1 / (1 + (hb + ha + st)) AS driving_smoothness,
    night AS night_driving_minutes,
    rush AS rush_hour_minutes,
    night / total_dur AS night_driving_ratio,
    rush / total_dur AS rush_hour_ratio,
    CAST(night > 0 AS INTEGER) AS has_night_driving,
    CAST(night / total_dur > 0.5 AS INTEGER) AS majority_night_driving,
    CAST(rush > 0 AS INTEGER) AS has_rush_hour_driving,
    weekend AS weekend_driving,
    night / total_dur * 0.3 + rush / total_dur * 0.2 + weekend * 0.1 AS time_risk_score,
    phone AS phone_use_minutes,
    phone / total_dur AS phone_use_ratio,
    CAST(phone > 0 AS INTEGER) AS has_phone_use,
    CAST(phone / total_dur > 0.1 AS INTEGER) AS excessive_phone_use,
    cont AS continuous_driving_hours,
    CAST(cont > 2 AS INTEGER) AS fatigue_risk,
    CAST(cont > 4 AS INTEGER) AS high_fatigue_risk,
    aw AS adverse_weather,
    rain AS rain_driving,
    snow AS snow_driving,
    fog AS fog_driving,
    aw * 0.2 + rain * 0.3 + snow * 0.4 + fog * 0.3 AS weather_risk_score,
    traffic AS high_traffic_ratio,
    CAST(traffic > 0.5 AS INTEGER) AS traffic_risk,
    CAST(phone > 0 AS INTEGER) + CAST(cont > 2 AS INTEGER) + aw + CAST(traffic > 0.5 AS INTEGER)
      AS total_risk_factors
  FROM fb
),
f2 AS (
  SELECT *,
    max_speed_kmh * total_aggressive_events / 100 AS speed_aggression_interaction,
    night_driving_ratio * max_speed_kmh / 100 AS night_speed_risk,
    log_trip_distance * aggressive_events_rate AS long_trip_aggression,
    phone_use_ratio * speeding_severity AS distracted_speeding,
    continuous_driving_hours * night_driving_ratio AS fatigue_night_risk,
    weather_risk_score * total_aggressive_events AS weather_aggression_risk,
    least(speed_variance * 0.15 + aggressive_events_rate * 0.25 + time_risk_score * 0.20
          + phone_use_ratio * 0.20 + weather_risk_score * 0.20, 1.0) AS composite_risk_score
  FROM f1
),
feats AS (
  SELECT trip_id, driver_id, """ + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in FE.FEATURE_NAMES) + """
  FROM f2
)"""

FEATS_WITH = with_views("trip_inputs") + "," + FEATURES_SQL


def _features(spark, sf):
    return FE.create_features(views.trip_inputs_metric(views.trips(spark, sf)))


@register("trip_features_57", rnd(FEATS_WITH + "\nSELECT * FROM feats", list(FE.FEATURE_NAMES)))
def q_trip_features(spark, sf):
    """T2-T8 (+T11 bridge): the 57 model features per trip, ids alongside."""
    return rounded(_features(spark, sf))


INPUT_DOUBLES = ["trip_duration_minutes", "trip_distance_km", "max_speed_kmh", "avg_speed_kmh", "hard_braking_count",
                 "hard_acceleration_count", "sharp_turn_count", "night_driving_minutes", "rush_hour_minutes",
                 "phone_use_minutes", "weekend_driving", "continuous_driving_hours"]


@register("trip_inputs_metric", rnd(with_views("trip_inputs") + "\nSELECT * FROM trip_inputs", INPUT_DOUBLES))
def q_trip_inputs(spark, sf):
    """Imperial trip summary -> metric feature inputs."""
    return rounded(views.trip_inputs_metric(views.trips(spark, sf)))


LONG_SQL = """
long AS (
  SELECT feature, v FROM feats UNPIVOT INCLUDE NULLS (v FOR feature IN (""" + ", ".join(FE.FEATURE_NAMES) + """))
),
stats AS (
  SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
    avg(CAST(v IS NULL AS DOUBLE)) AS missing_ratio,
    CAST(count(*) FILTER (WHERE isinf(v)) AS BIGINT) AS n_inf
  FROM long GROUP BY feature
)"""


@register("feature_stats", rnd(FEATS_WITH + "," + LONG_SQL + """
SELECT feature, mean, std, min, max, missing_ratio FROM stats""", ["mean", "std", "min", "max", "missing_ratio"]))
def q_feature_stats(spark, sf):
    """Per-feature mean, std, min, max, missing ratio (long form)."""
    return rounded(FE.feature_stats(_features(spark, sf)))


@register("feature_validation", rnd(FEATS_WITH + "," + LONG_SQL + """
SELECT feature, missing_ratio, min, max,
  CAST(missing_ratio > 0.1 AS INTEGER) AS high_missing,
  CAST(min IS NOT DISTINCT FROM max AS INTEGER) AS is_constant,
  CAST(n_inf > 0 AS INTEGER) AS has_infinite,
  CAST(coalesce((feature LIKE '%count%' OR feature LIKE '%minutes%' OR feature LIKE '%hours%') AND min < 0, false)
       AS INTEGER) AS negative_values,
  CAST(coalesce((feature LIKE '%ratio%' OR feature LIKE '%indicator%') AND (min < 0 OR max > 1), false)
       AS INTEGER) AS outside_unit_range,
  CAST(n_inf = 0 AND NOT coalesce((feature LIKE '%count%' OR feature LIKE '%minutes%' OR feature LIKE '%hours%')
       AND min < 0, false) AS INTEGER) AS valid
FROM stats""", ["missing_ratio", "min", "max"]))
def q_feature_validation(spark, sf):
    """missing, constant, infinite, negative-count and unit-range checks."""
    return rounded(FE.feature_validation(_features(spark, sf)))


@register("feature_importance_hints", rnd(FEATS_WITH + "," + LONG_SQL + """,
hints(feature, hint) AS (VALUES """ + ", ".join(f"('{k}', {v!r})" for k, v in FE.IMPORTANCE_HINTS.items()) + """)
SELECT s.feature, coalesce(h.hint, 0.3) AS importance_hint, s.mean, s.std
FROM stats s LEFT JOIN hints h ON s.feature = h.feature""", ["importance_hint", "mean", "std"]))
def q_importance_hints(spark, sf):
    """Domain importance hint per feature next to its observed stats."""
    st = FE.feature_stats(_features(spark, sf))
    hints = FE.importance_hints(spark).select("feature", "importance_hint")
    return rounded(st.join(F.broadcast(hints), "feature", "left").select("feature", "importance_hint", "mean", "std"))


BASIC_COLS = ["driver_id", "total_trips", "duration_minutes_sum", "duration_minutes_mean", "duration_minutes_std",
              "distance_miles_sum", "distance_miles_mean", "distance_miles_std", "average_speed_mph_mean",
              "average_speed_mph_std", "max_speed_mph_mean", "max_speed_mph_max", "harsh_braking_events_sum",
              "harsh_braking_events_mean", "harsh_acceleration_events_sum", "harsh_acceleration_events_mean",
              "sharp_cornering_events_sum", "sharp_cornering_events_mean", "phone_usage_seconds_sum",
              "phone_usage_seconds_mean", "speeding_percent_mean", "speeding_percent_max", "night_driving_mean",
              "rush_hour_mean", "events_per_mile", "phone_usage_per_hour", "speed_consistency",
              "night_driving_pct", "early_morning_driving_pct"]


NULL_AUDIT_SQL = "WITH b AS (" + BASIC_SQL + ")\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM b" for c in BASIC_COLS)


@register("null_audit", NULL_AUDIT_SQL)
def q_null_audit(spark, sf):
    """F8: null count per column of the basic driver table (one pass)."""
    return FE.null_audit(D.driver_features_basic(views.trips(spark, sf)))


IMPUTE = ["duration_minutes_std", "distance_miles_std", "average_speed_mph_std", "speed_consistency"]


@register("median_impute", rnd("WITH b AS (" + BASIC_SQL + "),\nm AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}" for c in IMPUTE) + " FROM b)\nSELECT driver_id, " + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in IMPUTE) + " FROM b CROSS JOIN m", IMPUTE))
def q_median_impute(spark, sf):
    """+-inf -> NULL -> column median for the std-based driver columns."""
    d = D.driver_features_basic(views.trips(spark, sf)).select("driver_id", *IMPUTE)
    return rounded(FE.median_impute(d, IMPUTE))


@register("events_per_mile", rnd(with_views("trips") + """
SELECT trip_id, harsh_braking_events + harsh_acceleration_events + sharp_cornering_events AS total_harsh_events,
  (harsh_braking_events + harsh_acceleration_events + sharp_cornering_events) / greatest(distance_miles, 0.1)
    AS events_per_mile
FROM trips""", ["events_per_mile"]))
def q_events_per_mile(spark, sf):
    """Harsh events per mile with a 0.1-mile floor."""
    return rounded(FE.eda_events_per_mile(views.trips(spark, sf)).select("trip_id", "total_harsh_events",
                                                                         "events_per_mile"))
