"""Trips -> drivers queries (T1, G1-G13, M15b) on the `trips` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import drivers as D
from ..operators import features as FE
from . import views
from .catalog import register, rounded
from .oracle_sql import agg_list, rnd
from .oracle_views import with_views

ENRICHED_SQL = """
enriched0 AS (
  SELECT *,
    max_speed_mph - average_speed_mph AS speed_variance,
    max_speed_mph / (average_speed_mph + 1e-6) AS speed_ratio,
    CAST(max_speed_mph > 80 AS INTEGER) AS high_speed_flag,
    CAST(max_speed_mph > 100 AS INTEGER) AS excessive_speed_flag,
    harsh_braking_events + harsh_acceleration_events + sharp_cornering_events AS total_harsh_events,
    (harsh_braking_events + harsh_acceleration_events + sharp_cornering_events) / (distance_miles + 1e-6)
      AS harsh_events_per_mile,
    (harsh_braking_events + harsh_acceleration_events + sharp_cornering_events) / (duration_minutes + 1e-6)
      AS harsh_events_per_minute,
    CASE WHEN duration_minutes * 60 <> 0 THEN phone_usage_seconds / (duration_minutes * 60) END * 100
      AS phone_usage_percent,
    CAST(phone_usage_seconds > 0 AS INTEGER) AS phone_usage_flag,
    distance_miles / (duration_minutes + 1e-6) AS trip_efficiency,
    CAST(distance_miles > 50 AS INTEGER) AS long_trip_flag,
    CAST(distance_miles < 5 AS INTEGER) AS short_trip_flag,
    CAST(duration_minutes > 120 AS INTEGER) AS extended_duration_flag,
    CAST(night_driving = 1 OR rush_hour = 1 AS INTEGER) AS high_risk_time,
    CAST(data_quality_score < 0.8 AS INTEGER) AS low_quality_data,
    CAST(gps_accuracy_avg > 10 AS INTEGER) AS poor_gps_accuracy
  FROM trips
),
enriched AS (
  SELECT *, CAST(coalesce(phone_usage_percent > 10, false) AS INTEGER) AS excessive_phone_use FROM enriched0
)"""

ENRICHED_DOUBLES = ["speed_variance", "speed_ratio", "harsh_events_per_mile", "harsh_events_per_minute",
                    "phone_usage_percent", "trip_efficiency"]


@register("enrich_trips", rnd(with_views("trips") + "," + ENRICHED_SQL + "\nSELECT * EXCLUDE (trip_date) FROM enriched",
                              ENRICHED_DOUBLES + ["claim_amount"]))
def q_enrich_trips(spark, sf):
    """17 imperial trip-level derived columns."""
    return rounded(FE.enrich_trips(views.trips(spark, sf)).drop("trip_date"))


BASIC_SQL = with_views("trips") + f"""
SELECT driver_id,
  {agg_list(D.BASIC_RULES, {"trip_id_count": "total_trips"})},
  CAST(sum(harsh_braking_events) + sum(harsh_acceleration_events) + sum(sharp_cornering_events) AS DOUBLE)
    / greatest(sum(distance_miles), 1.0) AS events_per_mile,
  sum(phone_usage_seconds) / greatest(sum(duration_minutes) / 60, 0.1) AS phone_usage_per_hour,
  1 / (1 + stddev_samp(average_speed_mph)) AS speed_consistency,
  sum(CASE WHEN time_of_day = 'night' THEN 1 ELSE 0 END) / count(time_of_day) AS night_driving_pct,
  sum(CASE WHEN time_of_day = 'early_morning' THEN 1 ELSE 0 END) / count(time_of_day) AS early_morning_driving_pct
FROM trips WHERE driver_id IS NOT NULL GROUP BY driver_id"""
BASIC_DOUBLES = ["duration_minutes_sum", "duration_minutes_mean", "duration_minutes_std", "distance_miles_sum",
                 "distance_miles_mean", "distance_miles_std", "average_speed_mph_mean", "average_speed_mph_std",
                 "max_speed_mph_mean", "max_speed_mph_max", "harsh_braking_events_mean",
                 "harsh_acceleration_events_mean", "sharp_cornering_events_mean", "phone_usage_seconds_mean",
                 "speeding_percent_mean", "speeding_percent_max", "night_driving_mean", "rush_hour_mean",
                 "events_per_mile", "phone_usage_per_hour", "speed_consistency", "night_driving_pct",
                 "early_morning_driving_pct"]


@register("driver_features_basic", rnd(BASIC_SQL, BASIC_DOUBLES))
def q_driver_features_basic(spark, sf):
    """Basic driver aggregate, ratios and high-risk time shares."""
    return rounded(D.driver_features_basic(views.trips(spark, sf)))


FULL_SQL = f"""
full_agg AS (
  SELECT driver_id,
  {agg_list(D.FULL_RULES, D.FULL_RENAMES, digits=4)}
  FROM enriched WHERE driver_id IS NOT NULL GROUP BY driver_id
),
freq AS (
  SELECT *,
    total_trips / 30 AS avg_trips_per_day,
    total_distance_miles / total_trips AS avg_miles_per_trip,
    total_driving_time_minutes / total_trips AS avg_duration_per_trip,
    CAST(total_distance_miles > 1000 AS INTEGER) AS high_mileage_driver,
    CAST(total_trips > 50 AS INTEGER) AS frequent_driver,
    CAST(coalesce(duration_minutes_std < 30, false) AS INTEGER) AS consistent_driver
  FROM full_agg
),
risk0 AS (
  SELECT *,
    harsh_braking_events_mean + harsh_acceleration_events_mean + sharp_cornering_events_mean
      AS harsh_driving_intensity,
    speeding_percent_mean * 0.4 + high_speed_flag_mean * 30 + excessive_speed_flag_mean * 50 AS speed_risk_score,
    phone_usage_percent_mean * 2 + excessive_phone_use_mean * 20 AS distraction_risk_score,
    night_driving_mean * 15 + rush_hour_mean * 10 AS timing_risk_score
  FROM freq
),
profiles AS (
  SELECT *, CASE WHEN composite_risk_score > -1e308 AND composite_risk_score <= 10 THEN 'Low'
                 WHEN composite_risk_score > 10 AND composite_risk_score <= 25 THEN 'Medium'
                 WHEN composite_risk_score > 25 AND composite_risk_score <= 50 THEN 'High'
                 WHEN composite_risk_score > 50 THEN 'Very High' END AS risk_category
  FROM (SELECT *, harsh_driving_intensity * 10 + speed_risk_score * 0.3 + distraction_risk_score * 0.5
                  + timing_risk_score * 0.2 AS composite_risk_score FROM risk0)
)"""
FULL_DOUBLES = [n for n in (
    "duration_minutes_mean", "duration_minutes_std", "total_driving_time_minutes", "distance_miles_mean",
    "distance_miles_std", "total_distance_miles", "average_speed_mph_mean", "average_speed_mph_std",
    "max_speed_mph_mean", "max_speed_mph_max", "harsh_braking_events_mean", "harsh_braking_events_sum",
    "harsh_acceleration_events_mean", "harsh_acceleration_events_sum", "sharp_cornering_events_mean",
    "sharp_cornering_events_sum", "total_harsh_events_mean", "total_harsh_events_sum", "harsh_events_per_mile_mean",
    "harsh_events_per_minute_mean", "phone_usage_seconds_mean", "phone_usage_seconds_sum",
    "phone_usage_percent_mean", "phone_usage_flag_mean", "excessive_phone_use_mean", "speeding_percent_mean",
    "speed_variance_mean", "speed_ratio_mean", "high_speed_flag_mean", "excessive_speed_flag_mean",
    "night_driving_mean", "rush_hour_mean", "high_risk_time_mean", "long_trip_flag_mean", "short_trip_flag_mean",
    "extended_duration_flag_mean", "trip_efficiency_mean", "data_quality_score_mean", "gps_accuracy_avg_mean",
    "low_quality_data_mean", "poor_gps_accuracy_mean")]
ADV_DOUBLES = ["avg_trips_per_day", "avg_miles_per_trip", "avg_duration_per_trip", "harsh_driving_intensity",
               "speed_risk_score", "distraction_risk_score", "timing_risk_score", "composite_risk_score"]


@register("driver_features_full",
          rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + "\nSELECT * FROM full_agg", FULL_DOUBLES))
def q_driver_features_full(spark, sf):
    """42 driver aggregates rounded to 4 dp."""
    return rounded(D.driver_features_full(FE.enrich_trips(views.trips(spark, sf))))


@register("driver_frequency_experience",
          rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + """
SELECT driver_id, avg_trips_per_day, avg_miles_per_trip, avg_duration_per_trip, high_mileage_driver,
  frequent_driver, consistent_driver FROM freq""", ["avg_trips_per_day", "avg_miles_per_trip", "avg_duration_per_trip"]))
def q_driver_frequency(spark, sf):
    """Frequency and experience indicators."""
    d = D.driver_frequency_experience(D.driver_features_full(FE.enrich_trips(views.trips(spark, sf))))
    return rounded(d.select("driver_id", "avg_trips_per_day", "avg_miles_per_trip", "avg_duration_per_trip",
                            "high_mileage_driver", "frequent_driver", "consistent_driver"))


@register("driver_risk_scores",
          rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + """
SELECT driver_id, harsh_driving_intensity, speed_risk_score, distraction_risk_score, timing_risk_score,
  composite_risk_score, risk_category FROM profiles""", ADV_DOUBLES[3:]))
def q_driver_risk_scores(spark, sf):
    """G10 + Q15: risk scores and the right-closed composite category."""
    d = D.driver_profiles(FE.enrich_trips(views.trips(spark, sf)))
    return rounded(d.select("driver_id", "harsh_driving_intensity", "speed_risk_score", "distraction_risk_score",
                            "timing_risk_score", "composite_risk_score", "risk_category"))


@register("driver_profiles", rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL
                                 + "\nSELECT * FROM profiles", FULL_DOUBLES + ADV_DOUBLES))
def q_driver_profiles(spark, sf):
    """The 55-column driver table (G7 + G9 + G10)."""
    return rounded(D.driver_profiles(FE.enrich_trips(views.trips(spark, sf))))


@register("driver_risk_category", with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + """
SELECT risk_category, CAST(count(*) AS BIGINT) AS drivers FROM profiles
WHERE risk_category IS NOT NULL GROUP BY risk_category""")
def q_driver_risk_category(spark, sf):
    """Q1 on D6: drivers per composite risk category."""
    return A.value_counts(D.driver_profiles(FE.enrich_trips(views.trips(spark, sf))), "risk_category", "drivers")


TOD = ("early_morning", "morning_commute", "midday", "evening_commute", "evening", "night")


@register("driver_time_share_pivot", rnd(with_views("trips") + """
SELECT driver_id, """ + ",\n  ".join(
    f"sum(CASE WHEN time_of_day = '{c}' THEN 1 ELSE 0 END) / count(*) AS {c}_share" for c in TOD) + """
FROM trips WHERE driver_id IS NOT NULL AND time_of_day IS NOT NULL GROUP BY driver_id""", [f"{c}_share" for c in TOD]))
def q_driver_time_share(spark, sf):
    """Time-of-day shares per driver via pivot with fixed values."""
    return rounded(D.driver_time_share_pivot(views.trips(spark, sf)))


HOURLY_SQL = """
hr AS (
  SELECT driver_id,
    CAST(sum(harsh_braking_events) AS BIGINT) AS harsh_braking_events,
    CAST(sum(harsh_acceleration_events) AS BIGINT) AS harsh_acceleration_events,
    CAST(sum(sharp_cornering_events) AS BIGINT) AS sharp_cornering_events,
    CAST(sum(phone_usage_seconds) AS BIGINT) AS phone_usage_seconds,
    avg(speeding_percent) AS speeding_percent, avg(night_driving) AS night_driving,
    sum(duration_minutes) AS duration_minutes
  FROM trips WHERE driver_id IS NOT NULL GROUP BY driver_id
),
hr2 AS (
  SELECT *,
    CASE WHEN duration_minutes / 60 <> 0 THEN
      (harsh_braking_events + harsh_acceleration_events + sharp_cornering_events) / (duration_minutes / 60) END
      AS harsh_events_per_hour,
    CASE WHEN duration_minutes / 60 <> 0 THEN phone_usage_seconds / (duration_minutes / 60) END AS phone_usage_per_hour
  FROM hr
),
mm AS (
  SELECT min(harsh_events_per_hour) AS a0, max(harsh_events_per_hour) AS a1,
         min(phone_usage_per_hour) AS b0, max(phone_usage_per_hour) AS b1,
         min(speeding_percent) AS c0, max(speeding_percent) AS c1,
         min(night_driving) AS d0, max(night_driving) AS d1
  FROM hr2
),
mmr AS (
  SELECT hr2.*, (
      CASE WHEN a1 - a0 = 0 THEN 0.0 ELSE (harsh_events_per_hour - a0) / (a1 - a0) * 100 END
    + CASE WHEN b1 - b0 = 0 THEN 0.0 ELSE (phone_usage_per_hour - b0) / (b1 - b0) * 100 END
    + CASE WHEN c1 - c0 = 0 THEN 0.0 ELSE (speeding_percent - c0) / (c1 - c0) * 100 END
    + CASE WHEN d1 - d0 = 0 THEN 0.0 ELSE (night_driving - d0) / (d1 - d0) * 100 END) / 4 AS risk_score
  FROM hr2 CROSS JOIN mm
)"""
HOURLY_DOUBLES = ["speeding_percent", "night_driving", "duration_minutes", "harsh_events_per_hour",
                  "phone_usage_per_hour"]


@register("driver_hourly_rates", rnd(with_views("trips") + "," + HOURLY_SQL + "\nSELECT * FROM hr2", HOURLY_DOUBLES))
def q_driver_hourly(spark, sf):
    """Per-hour event and phone-use rates per driver."""
    return rounded(D.driver_hourly_rates(views.trips(spark, sf)))


@register("driver_minmax_risk", rnd(with_views("trips") + "," + HOURLY_SQL + """
SELECT driver_id, harsh_events_per_hour, phone_usage_per_hour, speeding_percent, night_driving, risk_score
FROM mmr""", ["harsh_events_per_hour", "phone_usage_per_hour", "speeding_percent", "night_driving", "risk_score"]))
def q_driver_minmax(spark, sf):
    """0-100 min-max scaled risk score (global min/max broadcast)."""
    d = D.minmax_risk_score(D.driver_hourly_rates(views.trips(spark, sf)))
    return rounded(d.select("driver_id", *D.MINMAX_FACTORS, "risk_score"))


@register("high_risk_drivers_p90", rnd(with_views("trips") + "," + HOURLY_SQL + """
SELECT driver_id, harsh_events_per_hour, phone_usage_per_hour, speeding_percent, night_driving, risk_score
FROM mmr WHERE risk_score > (SELECT quantile_cont(risk_score, 0.9) FROM mmr)""",
                                           ["harsh_events_per_hour", "phone_usage_per_hour", "speeding_percent",
                                            "night_driving", "risk_score"]))
def q_high_risk_p90(spark, sf):
    """Q12: drivers above the 90th percentile of the min-max risk score."""
    d = D.minmax_risk_score(D.driver_hourly_rates(views.trips(spark, sf)))
    d = A.above_quantile(d, "risk_score", 0.9)
    return rounded(d.select("driver_id", *D.MINMAX_FACTORS, "risk_score"))


@register("high_risk_profile", rnd(with_views("trips") + "," + HOURLY_SQL + """,
hi AS (SELECT * FROM mmr WHERE risk_score > (SELECT quantile_cont(risk_score, 0.9) FROM mmr))
SELECT column_name, count, mean, std, min, p25, p50, p75, max FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
    min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
    quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM hi"""
    for c in (*D.MINMAX_FACTORS, "risk_score")) + ")",
    ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def q_high_risk_profile(spark, sf):
    """Q23: describe of the top-decile drivers."""
    d = A.above_quantile(D.minmax_risk_score(D.driver_hourly_rates(views.trips(spark, sf))), "risk_score", 0.9)
    return rounded(A.describe(d, [*D.MINMAX_FACTORS, "risk_score"]))


@register("eda_driver_stats", with_views("trips") + f"""
SELECT driver_id, {agg_list(D.EDA_RULES, {"trip_id_count": "total_trips"}, digits=2)}
FROM trips WHERE driver_id IS NOT NULL GROUP BY driver_id""")
def q_eda_driver_stats(spark, sf):
    """EDA driver statistics rounded to 2 dp."""
    return D.eda_driver_stats(views.trips(spark, sf))


POC_SQL = """
SELECT driver_id,
  CASE WHEN distance_miles_sum <> 0 THEN (harsh_braking_events_sum + harsh_acceleration_events_sum
       + sharp_cornering_events_sum) / distance_miles_sum END AS poc_events_per_mile,
  CASE WHEN duration_minutes_sum / 60 <> 0 THEN phone_usage_seconds_sum / (duration_minutes_sum / 60) END
    AS poc_phone_usage_per_hour,
  night_driving_mean * distance_miles_sum AS night_driving_miles,
  speeding_percent_mean * max_speed_mph_mean AS speeding_severity
FROM (""" + BASIC_SQL + ") AS b"


@register("poc_driver_features", rnd(POC_SQL, ["poc_events_per_mile", "poc_phone_usage_per_hour",
                                               "night_driving_miles", "speeding_severity"]))
def q_poc_driver_features(spark, sf):
    """POC driver ratios (no clipping)."""
    d = D.poc_driver_features(D.driver_features_basic(views.trips(spark, sf)))
    return rounded(d.select("driver_id", "poc_events_per_mile", "poc_phone_usage_per_hour", "night_driving_miles",
                            "speeding_severity"))


@register("driver_prior_risk", rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + """,
mx AS (SELECT max(composite_risk_score) AS m_c, max(harsh_driving_intensity) AS m_h, max(speed_risk_score) AS m_s,
              max(distraction_risk_score) AS m_d, max(total_distance_miles) AS m_t FROM profiles)
SELECT driver_id,
  least(greatest(0.05 + 0.15 * (composite_risk_score / m_c) + 0.10 * (harsh_driving_intensity / m_h)
                 + 0.08 * (speed_risk_score / m_s) + 0.05 * (distraction_risk_score / m_d), 0.0), 0.4)
    AS prior_claim_probability,
  2000 * (1.0 + 0.8 * (composite_risk_score / m_c) + 0.6 * (speed_risk_score / m_s)
          + 0.4 * (harsh_driving_intensity / m_h) + 0.3 * (total_distance_miles / m_t)
          + 0.2 * night_driving_mean + 0.1 * excessive_speed_flag_mean) AS expected_claim_severity
FROM profiles CROSS JOIN mx""", ["prior_claim_probability", "expected_claim_severity"]))
def q_driver_prior_risk(spark, sf):
    """Rule-based prior claim probability and expected severity per driver."""
    return rounded(D.driver_prior_risk(D.driver_profiles(FE.enrich_trips(views.trips(spark, sf)))))


@register("driver_claims", rnd(with_views("trips") + """
SELECT driver_id, CAST(sum(has_claim) AS BIGINT) AS had_claim_sum, avg(has_claim) AS had_claim_mean,
  sum(claim_amount) AS claim_amount_sum, avg(claim_amount) AS claim_amount_mean
FROM trips GROUP BY driver_id""", ["had_claim_mean", "claim_amount_sum", "claim_amount_mean"]))
def q_driver_claims(spark, sf):
    """D12 claim columns per driver."""
    return rounded(D.driver_claims(views.trips(spark, sf)))


__all__ = ["F"]
