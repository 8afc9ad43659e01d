"""Exploratory and segment analytics (Q1-Q23, V10) on the trips/scored views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r as round6
from ..operators import analytics as A
from ..operators import drivers as D
from ..operators import features as FE
from ..operators import trips as TR
from . import views
from .catalog import R, register, rounded
from .oracle_sql import rnd
from .oracle_views import with_views
from .q_drivers import ENRICHED_SQL, FULL_SQL, HOURLY_SQL

TRIP_NUMERIC = ["duration_minutes", "distance_miles", "average_speed_mph", "max_speed_mph", "harsh_braking_events",
                "harsh_acceleration_events", "sharp_cornering_events", "phone_usage_seconds", "speeding_percent",
                "night_driving", "rush_hour"]
DESCRIBE_DOUBLES = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@register("describe_trips", rnd(with_views("trips") + "\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
    stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min,
    quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50,
    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM trips"""
    for c in TRIP_NUMERIC), DESCRIBE_DOUBLES))
def q_describe(spark, sf):
    """Q7: describe() of the numeric trip columns with exact quartiles."""
    return rounded(A.describe(views.trips(spark, sf), TRIP_NUMERIC))


@register("value_counts_time_of_day", with_views("trips") + """
SELECT time_of_day, count(*) AS trips FROM trips WHERE time_of_day IS NOT NULL GROUP BY time_of_day""")
def q_vc_tod(spark, sf):
    """Q1: trips per time-of-day category."""
    return A.value_counts(views.trips(spark, sf), "time_of_day", "trips")


@register("value_counts_claims", with_views("trips") + """
SELECT has_claim, count(*) AS trips FROM trips WHERE has_claim IS NOT NULL GROUP BY has_claim""")
def q_vc_claims(spark, sf):
    """Q1: claim / no-claim counts."""
    return A.value_counts(views.trips(spark, sf), "has_claim", "trips")


@register("topk_zones", with_views("trips") + """
SELECT * FROM (SELECT 'start' AS kind, start_zone AS zone, count(*) AS trips FROM trips WHERE start_zone IS NOT NULL
               GROUP BY start_zone ORDER BY trips DESC, zone LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'end' AS kind, end_zone AS zone, count(*) AS trips FROM trips WHERE end_zone IS NOT NULL
               GROUP BY end_zone ORDER BY trips DESC, zone LIMIT 20)""")
def q_topk_zones(spark, sf):
    """Q2: 20 most common start and end zones (ties by zone name)."""
    t = views.trips(spark, sf)
    s = A.top_k(t, ["start_zone"]).select(F.lit("start").alias("kind"), F.col("start_zone").alias("zone"), "trips")
    e = A.top_k(t, ["end_zone"]).select(F.lit("end").alias("kind"), F.col("end_zone").alias("zone"), "trips")
    return s.unionByName(e)


@register("topk_routes", with_views("trips") + """
SELECT start_zone, end_zone, count(*) AS trips FROM trips
WHERE start_zone IS NOT NULL AND end_zone IS NOT NULL
GROUP BY start_zone, end_zone ORDER BY trips DESC, start_zone, end_zone LIMIT 20""")
def q_topk_routes(spark, sf):
    """Q3: 20 most common (start, end) zone pairs."""
    return A.top_k(views.trips(spark, sf), ["start_zone", "end_zone"])


@register("top_risk_drivers", rnd(with_views("trips") + "," + HOURLY_SQL + """
SELECT driver_id, risk_score FROM mmr ORDER BY risk_score DESC, driver_id LIMIT 5""", ["risk_score"]))
def q_top_risk(spark, sf):
    """Q4: nlargest(5) drivers by min-max risk score."""
    d = D.minmax_risk_score(D.driver_hourly_rates(views.trips(spark, sf)))
    return rounded(A.top_n_rows(d, "risk_score", 5, tie=["driver_id"]).select("driver_id", "risk_score"))


@register("weekday_profile", rnd(with_views("trips") + """,
dim(day_order, day_of_week) AS (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'),
                                       (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')),
agg AS (
  SELECT dayname(trip_date) AS day_of_week, count(*) AS trips, avg(distance_miles) AS distance_miles_mean,
    avg(harsh_braking_events + harsh_acceleration_events + sharp_cornering_events) AS total_harsh_events_mean
  FROM trips GROUP BY 1
)
SELECT day_order, day_of_week, coalesce(trips, 0) AS trips, distance_miles_mean, total_harsh_events_mean
FROM dim LEFT JOIN agg USING (day_of_week)""", ["distance_miles_mean", "total_harsh_events_mean"]))
def q_weekday(spark, sf):
    """Q10 + T13: Monday..Sunday profile from the real trip date."""
    return rounded(A.weekday_profile(views.trips(spark, sf)))


@register("week_profile", rnd(with_views("trips") + """
SELECT CAST(week(trip_date) AS INTEGER) AS week_number, dayname(trip_date) AS day_of_week, count(*) AS trips,
  avg(distance_miles) AS distance_miles_mean
FROM trips GROUP BY 1, 2""", ["distance_miles_mean"]))
def q_week_profile(spark, sf):
    """Trips by ISO week and weekday of the real trip date."""
    t = FE.calendar_columns(views.trips(spark, sf))
    return rounded(t.groupBy("week_number", "day_of_week").agg(F.count(F.lit(1)).alias("trips"), F.avg("distance_miles").alias("distance_miles_mean")))


@register("trip_batches_union", with_views("trips") + """
SELECT CASE trip_id % 3 WHEN 0 THEN 'whole' WHEN 1 THEN 'no zones' ELSE 'no distance' END AS batch, count(*) AS trips,
  CAST(count(CASE WHEN trip_id % 3 <> 1 THEN start_zone END) AS BIGINT) AS with_zone,
  CAST(count(CASE WHEN trip_id % 3 <> 2 THEN distance_miles END) AS BIGINT) AS with_distance,
  CAST(sum(trip_id) AS BIGINT) AS trip_id_sum
FROM trips GROUP BY 1""")
def q_batches(spark, sf):
    """Three batches, two of which lack columns, united by name."""
    t = views.trips(spark, sf)
    part = lambda i: t.filter(F.col("trip_id") % 3 == i)
    u = TR.union_batches({"whole": part(0), "no zones": part(1).drop("start_zone", "end_zone"), "no distance": part(2).drop("distance_miles")})
    return u.groupBy("batch").agg(F.count(F.lit(1)).alias("trips"), F.count("start_zone").alias("with_zone"),
                                  F.count("distance_miles").alias("with_distance"), F.sum("trip_id").alias("trip_id_sum"))


@register("time_of_day_rates", rnd(with_views("trips") + """
SELECT time_of_day, count(*) AS trips, avg(average_speed_mph) AS average_speed_mph_mean,
  avg(CAST(phone_usage_seconds > 0 AS INTEGER)) * 100 AS phone_usage_rate_pct
FROM trips WHERE time_of_day IS NOT NULL GROUP BY time_of_day""", ["average_speed_mph_mean", "phone_usage_rate_pct"]))
def q_tod_rates(spark, sf):
    """Q8/Q9: mean speed and phone-use rate by time of day."""
    return rounded(A.time_of_day_rates(views.trips(spark, sf)))


PRED_DOUBLES = ["trips_per_driver", "avg_duration_minutes", "avg_distance_miles", "avg_speed_mph", "night_rate_pct",
                "rush_rate_pct", "braking_rate_pct", "acceleration_rate_pct", "phone_rate_pct", "speeding_rate_pct",
                "avg_harsh_events"]


@register("predicate_rates", rnd(with_views("trips") + """
SELECT count(*) AS total_trips, count(DISTINCT driver_id) AS unique_drivers,
  count(*) / count(DISTINCT driver_id) AS trips_per_driver,
  avg(duration_minutes) AS avg_duration_minutes, avg(distance_miles) AS avg_distance_miles,
  avg(average_speed_mph) AS avg_speed_mph, avg(night_driving) * 100 AS night_rate_pct,
  avg(rush_hour) * 100 AS rush_rate_pct,
  avg(CAST(harsh_braking_events > 0 AS INTEGER)) * 100 AS braking_rate_pct,
  avg(CAST(harsh_acceleration_events > 0 AS INTEGER)) * 100 AS acceleration_rate_pct,
  avg(CAST(phone_usage_seconds > 0 AS INTEGER)) * 100 AS phone_rate_pct,
  avg(CAST(speeding_percent > 0 AS INTEGER)) * 100 AS speeding_rate_pct,
  avg(harsh_braking_events + harsh_acceleration_events + sharp_cornering_events) AS avg_harsh_events
FROM trips""", PRED_DOUBLES))
def q_predicate_rates(spark, sf):
    """Q6/Q11: overview counts and behaviour rates in one aggregate."""
    return rounded(A.predicate_rates(views.trips(spark, sf)))


CORR_COLS = ["average_speed_mph", "max_speed_mph", "harsh_braking_events", "harsh_acceleration_events",
             "sharp_cornering_events", "phone_usage_seconds", "speeding_percent", "night_driving", "rush_hour",
             "events_per_mile"]
_pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]


@register("correlation_matrix", rnd(with_views("trips") + """,
t AS (SELECT *, (harsh_braking_events + harsh_acceleration_events + sharp_cornering_events)
                / greatest(distance_miles, 0.1) AS events_per_mile FROM trips)
""" + " UNION ALL ".join(
    [f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM t" for a, b in _pairs]
    + [f"SELECT '{b}' AS x, '{a}' AS y, corr({a}, {b}) AS r FROM t" for a, b in _pairs]
    + [f"SELECT '{a}' AS x, '{a}' AS y, 1.0 AS r" for a in CORR_COLS]), ["r"]))
def q_correlation(spark, sf):
    """Q13: Pearson correlation matrix of 10 risk indicators (long form)."""
    return rounded(A.correlation_matrix(FE.eda_events_per_mile(views.trips(spark, sf)), CORR_COLS))


@register("linear_trend", rnd(with_views("trips") + """
SELECT regr_slope(distance_miles, duration_minutes) AS slope,
  regr_intercept(distance_miles, duration_minutes) AS intercept,
  regr_r2(distance_miles, duration_minutes) AS r2, count(*) AS n FROM trips""", ["slope", "intercept", "r2"]))
def q_linear_trend(spark, sf):
    """Q14: degree-1 fit of distance on duration."""
    return rounded(A.linear_trend(views.trips(spark, sf), "duration_minutes", "distance_miles"))


CLAIM_RATE_EDGES = (-0.001, 0.0, 0.01, 0.02, 1.0)
CLAIM_RATE_LABELS = ("No Risk", "Low Risk", "Medium Risk", "High Risk")


@register("fixed_bins", with_views("trips") + """,
dc AS (SELECT driver_id, avg(has_claim) AS had_claim_mean FROM trips GROUP BY driver_id),
b AS (SELECT CASE WHEN had_claim_mean > -0.001 AND had_claim_mean <= 0.0 THEN 'No Risk'
                  WHEN had_claim_mean > 0.0 AND had_claim_mean <= 0.01 THEN 'Low Risk'
                  WHEN had_claim_mean > 0.01 AND had_claim_mean <= 0.02 THEN 'Medium Risk'
                  WHEN had_claim_mean > 0.02 AND had_claim_mean <= 1.0 THEN 'High Risk' END AS claim_risk FROM dc),
dim(bin_rank, claim_risk) AS (VALUES (1, 'No Risk'), (2, 'Low Risk'), (3, 'Medium Risk'), (4, 'High Risk')),
agg AS (SELECT claim_risk, count(*) AS n FROM b WHERE claim_risk IS NOT NULL GROUP BY claim_risk)
SELECT bin_rank, claim_risk, coalesce(n, 0) AS n FROM dim LEFT JOIN agg USING (claim_risk)""")
def q_fixed_bins(spark, sf):
    """Q15: right-closed claim-rate bins per driver, empty bins listed."""
    d = A.labelled_bins(D.driver_claims(views.trips(spark, sf)), "had_claim_mean", CLAIM_RATE_EDGES,
                        CLAIM_RATE_LABELS, "claim_risk")
    return A.bin_counts(d, "claim_risk", CLAIM_RATE_LABELS)


TIERS = ("Very Low", "Low", "Medium", "High", "Very High")


def _tiers_sql():
    e = "e"
    cases = " ".join(f"WHEN risk_score <= {e}[{i + 2}] THEN {i + 1}" for i in range(5))
    return with_views("scored", "trips") + f""",
ds AS (SELECT driver_id, {R('100 * avg(claim_probability)', 1)} AS risk_score FROM scored GROUP BY driver_id),
ed AS (SELECT quantile_cont(risk_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM ds),
t AS (SELECT ds.*, CASE {cases} END AS tier_rank FROM ds CROSS JOIN ed),
bf AS (SELECT driver_id, avg(harsh_braking_events) AS hb, avg(phone_usage_seconds) AS ph,
              avg(speeding_percent) AS sp FROM trips GROUP BY driver_id)
SELECT tier_rank, ['Very Low', 'Low', 'Medium', 'High', 'Very High'][tier_rank] AS tier, count(*) AS drivers,
  min(risk_score) AS min_score, max(risk_score) AS max_score,
  avg(hb) AS harsh_braking_events_mean, avg(ph) AS phone_usage_seconds_mean, avg(sp) AS speeding_percent_mean
FROM t JOIN bf USING (driver_id) GROUP BY tier_rank"""


@register("quantile_tiers", rnd(_tiers_sql(), ["min_score", "max_score", "harsh_braking_events_mean",
                                               "phone_usage_seconds_mean", "speeding_percent_mean"]))
def q_quantile_tiers(spark, sf):
    """Q16 + R10: POC risk score round(100 p, 1) per driver, five qcut tiers
    (exact quantile edges, ties share a tier), factor means per tier."""
    sc = views.scored(spark, sf)
    ds = sc.groupBy("driver_id").agg(round6(100 * F.avg("claim_probability"), 1).alias("risk_score"))
    t = A.quantile_bins(ds, "risk_score", 5, TIERS, out="tier")
    basic = D.driver_features_basic(views.trips(spark, sf)).select(
        "driver_id", "harsh_braking_events_mean", "phone_usage_seconds_mean", "speeding_percent_mean")
    return rounded(t.join(basic, "driver_id").groupBy("tier_rank", "tier").agg(
        F.count(F.lit(1)).alias("drivers"), F.min("risk_score").alias("min_score"),
        F.max("risk_score").alias("max_score"),
        F.avg("harsh_braking_events_mean").alias("harsh_braking_events_mean"),
        F.avg("phone_usage_seconds_mean").alias("phone_usage_seconds_mean"),
        F.avg("speeding_percent_mean").alias("speeding_percent_mean")))


@register("histogram_duration", rnd(with_views("trips") + """,
mm AS (SELECT min(duration_minutes) AS mn, max(duration_minutes) AS mx, count(duration_minutes) AS n FROM trips),
b AS (SELECT CAST(CASE WHEN mx - mn = 0 THEN 0 ELSE least(floor((duration_minutes - mn) / (mx - mn) * 30), 29) END
                  AS INTEGER) AS bin
      FROM trips CROSS JOIN mm WHERE duration_minutes IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
r AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT r.bin, mn + r.bin * ((mx - mn) / 30) AS bin_start, mn + (r.bin + 1) * ((mx - mn) / 30) AS bin_end,
  coalesce(cnt, 0) AS count, coalesce(cnt, 0) / (n * ((mx - mn) / 30)) AS density
FROM r CROSS JOIN mm LEFT JOIN c ON r.bin = c.bin""", ["bin_start", "bin_end", "density"]))
def q_histogram(spark, sf):
    """Q17: 30 equal-width bins of trip duration (counts + density)."""
    return rounded(A.histogram(views.trips(spark, sf), "duration_minutes", 30))


@register("boxplot_by_time_of_day", rnd(with_views("trips") + """,
q AS (SELECT time_of_day, quantile_cont(distance_miles, 0.25) AS q1, quantile_cont(distance_miles, 0.5) AS median,
             quantile_cont(distance_miles, 0.75) AS q3, count(distance_miles) AS n
      FROM trips WHERE time_of_day IS NOT NULL GROUP BY time_of_day),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
w AS (SELECT t.time_of_day,
             min(CASE WHEN distance_miles >= lo AND distance_miles <= hi THEN distance_miles END) AS whisker_low,
             max(CASE WHEN distance_miles >= lo AND distance_miles <= hi THEN distance_miles END) AS whisker_high,
             count(*) FILTER (WHERE NOT (distance_miles >= lo AND distance_miles <= hi)) AS outliers
      FROM trips t JOIN f ON t.time_of_day = f.time_of_day GROUP BY t.time_of_day)
SELECT f.time_of_day, q1, median, q3, n, iqr, whisker_low, whisker_high, outliers
FROM f JOIN w ON f.time_of_day = w.time_of_day""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]))
def q_boxplot(spark, sf):
    """Q18: box-plot statistics of distance per time of day."""
    return rounded(A.boxplot_stats(views.trips(spark, sf), "time_of_day", "distance_miles"))


SEG_SQL = with_views("scored") + """,
s AS (SELECT CASE WHEN claim_probability > 0.0 AND claim_probability <= 0.1 THEN 'Low Risk'
                  WHEN claim_probability > 0.1 AND claim_probability <= 0.2 THEN 'Medium Risk'
                  WHEN claim_probability > 0.2 AND claim_probability <= 0.3 THEN 'High Risk'
                  WHEN claim_probability > 0.3 AND claim_probability <= 1.0 THEN 'Very High Risk' END AS risk_segment,
             driver_id, has_claim, claim_probability FROM scored),
agg AS (SELECT risk_segment, count(driver_id) AS driver_count, CAST(sum(has_claim) AS BIGINT) AS actual_claims,
               avg(has_claim) AS claim_rate, avg(claim_probability) AS avg_predicted_prob,
               stddev_samp(claim_probability) AS std_predicted_prob
        FROM s WHERE risk_segment IS NOT NULL GROUP BY risk_segment),
overall AS (SELECT avg(has_claim) AS o FROM scored),
dim(segment_rank, risk_segment) AS (VALUES (1, 'Low Risk'), (2, 'Medium Risk'), (3, 'High Risk'),
                                           (4, 'Very High Risk'))
SELECT segment_rank, dim.risk_segment, coalesce(driver_count, 0) AS driver_count,
  coalesce(actual_claims, 0) AS actual_claims, claim_rate, avg_predicted_prob, std_predicted_prob,
  CASE WHEN o <> 0 THEN claim_rate / o END AS lift
FROM dim LEFT JOIN agg ON dim.risk_segment = agg.risk_segment CROSS JOIN overall"""


@register("segment_lift", rnd(SEG_SQL, ["claim_rate", "avg_predicted_prob", "std_predicted_prob", "lift"]))
def q_segment_lift(spark, sf):
    """Q19: right-closed probability segments with claim rate and lift."""
    return rounded(A.segment_lift(views.scored(spark, sf)))


RES_SQL = """
res AS (
  SELECT trip_id, driver_id, claim_amount AS actual_severity, claim_severity_prediction AS predicted_severity,
    claim_amount - claim_severity_prediction AS prediction_error,
    abs(claim_amount - claim_severity_prediction) AS absolute_error,
    CASE WHEN claim_amount <> 0 THEN abs(claim_amount - claim_severity_prediction) / claim_amount END * 100
      AS percentage_error
  FROM scored WHERE has_claim = 1
)"""
RES_DOUBLES = ["actual_severity", "predicted_severity", "prediction_error", "absolute_error", "percentage_error"]


def _residuals(spark, sf):
    sc = views.scored(spark, sf).filter("has_claim = 1").select(
        "trip_id", "driver_id", F.col("claim_amount").alias("actual_severity"),
        F.col("claim_severity_prediction").alias("predicted_severity"))
    return A.residuals(sc, "actual_severity", "predicted_severity")


@register("residuals", rnd(with_views("scored") + "," + RES_SQL + "\nSELECT * FROM res", RES_DOUBLES))
def q_residuals(spark, sf):
    """Per-claim error, absolute and percentage error."""
    return rounded(_residuals(spark, sf))


SEV_STATS = ["actual_mean", "actual_median", "actual_std", "pred_mean", "pred_median", "pred_std", "mae_mean",
             "mae_median", "mape_mean", "mape_median"]


@register("severity_segments", rnd(with_views("scored") + "," + RES_SQL + """,
s AS (SELECT *, CASE WHEN predicted_severity > 0.0 AND predicted_severity <= 2000.0 THEN 'Low Severity'
                     WHEN predicted_severity > 2000.0 AND predicted_severity <= 5000.0 THEN 'Medium Severity'
                     WHEN predicted_severity > 5000.0 AND predicted_severity <= 10000.0 THEN 'High Severity'
                     WHEN predicted_severity > 10000.0 THEN 'Very High Severity' END AS severity_segment FROM res),
agg AS (SELECT severity_segment, count(*) AS n,
          avg(actual_severity) AS actual_mean, median(actual_severity) AS actual_median,
          stddev_samp(actual_severity) AS actual_std,
          avg(predicted_severity) AS pred_mean, median(predicted_severity) AS pred_median,
          stddev_samp(predicted_severity) AS pred_std,
          avg(absolute_error) AS mae_mean, median(absolute_error) AS mae_median,
          avg(percentage_error) AS mape_mean, median(percentage_error) AS mape_median
        FROM s WHERE severity_segment IS NOT NULL GROUP BY severity_segment),
dim(segment_rank, severity_segment) AS (VALUES (1, 'Low Severity'), (2, 'Medium Severity'), (3, 'High Severity'),
                                               (4, 'Very High Severity'))
SELECT dim.severity_segment, segment_rank, coalesce(n, 0) AS n, """ + ", ".join(SEV_STATS) + """
FROM dim LEFT JOIN agg ON dim.severity_segment = agg.severity_segment""", SEV_STATS))
def q_severity_segments(spark, sf):
    """Q20: 11 statistics per predicted-severity segment."""
    return rounded(A.severity_segments(_residuals(spark, sf)))


@register("high_error_cases", rnd(with_views("scored") + "," + RES_SQL + """,
thr AS (SELECT quantile_cont(percentage_error, 0.9) AS threshold FROM res)
SELECT threshold, count(*) AS cases, avg(percentage_error) AS avg_percentage_error,
  avg(actual_severity) AS avg_actual, avg(predicted_severity) AS avg_predicted
FROM res CROSS JOIN thr WHERE percentage_error > threshold GROUP BY threshold""",
    ["threshold", "avg_percentage_error", "avg_actual", "avg_predicted"]))
def q_high_error(spark, sf):
    """Q22: claims above the 90th percentile of percentage error."""
    return rounded(A.high_error_summary(_residuals(spark, sf)))


@register("claim_stats_by_category", rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + """,
dc AS (SELECT driver_id, CAST(sum(has_claim) AS BIGINT) AS had_claim_sum, sum(claim_amount) AS claim_amount_sum
       FROM trips GROUP BY driver_id)
SELECT risk_category, count(claim_amount_sum) AS count, avg(claim_amount_sum) AS mean,
  median(claim_amount_sum) AS median, stddev_samp(claim_amount_sum) AS std, min(claim_amount_sum) AS min,
  max(claim_amount_sum) AS max
FROM profiles JOIN dc USING (driver_id) WHERE had_claim_sum > 0 AND risk_category IS NOT NULL
GROUP BY risk_category""", ["mean", "median", "std", "min", "max"]))
def q_claim_stats(spark, sf):
    """Q21: claim amount statistics by driver risk category (claimants only)."""
    t = views.trips(spark, sf)
    prof = D.driver_profiles(FE.enrich_trips(t)).select("driver_id", "risk_category")
    claims = D.driver_claims(t).filter("had_claim_sum > 0")
    return rounded(A.group_stats(prof.join(claims, "driver_id"), "risk_category", "claim_amount_sum"))


@register("probability_histogram_by_class", rnd(with_views("scored") + """,
mm AS (SELECT min(claim_probability) AS mn, max(claim_probability) AS mx FROM scored),
b AS (SELECT has_claim, CAST(CASE WHEN mx - mn = 0 THEN 0
                                  ELSE least(floor((claim_probability - mn) / (mx - mn) * 30), 29) END AS INTEGER) AS bin
      FROM scored CROSS JOIN mm WHERE claim_probability IS NOT NULL),
c AS (SELECT has_claim, bin, count(*) AS cnt FROM b GROUP BY has_claim, bin),
tot AS (SELECT has_claim, sum(cnt) AS n FROM c GROUP BY has_claim),
r AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT tot.has_claim, r.bin, mn + r.bin * ((mx - mn) / 30) AS bin_start, mn + (r.bin + 1) * ((mx - mn) / 30) AS bin_end,
  coalesce(cnt, 0) AS count, coalesce(cnt, 0) / (n * ((mx - mn) / 30)) AS density
FROM r CROSS JOIN mm CROSS JOIN tot LEFT JOIN c ON r.bin = c.bin AND tot.has_claim = c.has_claim""",
    ["bin_start", "bin_end", "density"]))
def q_prob_hist(spark, sf):
    """Q17: 30-bin density of the claim probability per actual class."""
    return rounded(A.histogram(views.scored(spark, sf), "claim_probability", 30, by="has_claim"))


@register("phone_usage_histogram", rnd(with_views("trips") + """,
p AS (SELECT phone_usage_seconds AS x FROM trips WHERE phone_usage_seconds > 0),
mm AS (SELECT min(x) AS mn, max(x) AS mx FROM p),
b AS (SELECT CAST(CASE WHEN mx - mn = 0 THEN 0 ELSE least(floor((x - mn) / (mx - mn) * 30), 29) END AS INTEGER) AS bin
      FROM p CROSS JOIN mm),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
tot AS (SELECT sum(cnt) AS n FROM c),
r AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT r.bin, mn + r.bin * ((mx - mn) / 30) AS bin_start, mn + (r.bin + 1) * ((mx - mn) / 30) AS bin_end,
  coalesce(cnt, 0) AS count, coalesce(cnt, 0) / (n * ((mx - mn) / 30)) AS density
FROM r CROSS JOIN mm CROSS JOIN tot LEFT JOIN c ON r.bin = c.bin""", ["bin_start", "bin_end", "density"]))
def q_phone_hist(spark, sf):
    """F11 + Q17: phone-use seconds among trips with any phone use."""
    t = views.trips(spark, sf).filter(F.col("phone_usage_seconds") > 0)
    return rounded(A.histogram(t, "phone_usage_seconds", 30))


@register("error_by_prediction_quartile", rnd(with_views("scored") + "," + RES_SQL + """,
ed AS (SELECT quantile_cont(predicted_severity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM res),
qd AS (SELECT res.*, CASE WHEN predicted_severity <= e[2] THEN 1 WHEN predicted_severity <= e[3] THEN 2
                          WHEN predicted_severity <= e[4] THEN 3 WHEN predicted_severity <= e[5] THEN 4 END AS q
       FROM res CROSS JOIN ed),
lab AS (SELECT *, ['Q1', 'Q2', 'Q3', 'Q4'][q] AS quartile FROM qd),
s AS (SELECT quartile, quantile_cont(absolute_error, 0.25) AS q1, quantile_cont(absolute_error, 0.5) AS median,
             quantile_cont(absolute_error, 0.75) AS q3, count(absolute_error) AS n
      FROM lab WHERE quartile IS NOT NULL GROUP BY quartile),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
w AS (SELECT l.quartile,
             min(CASE WHEN absolute_error >= lo AND absolute_error <= hi THEN absolute_error END) AS whisker_low,
             max(CASE WHEN absolute_error >= lo AND absolute_error <= hi THEN absolute_error END) AS whisker_high,
             count(*) FILTER (WHERE NOT (absolute_error >= lo AND absolute_error <= hi)) AS outliers
      FROM lab l JOIN f ON l.quartile = f.quartile GROUP BY l.quartile)
SELECT f.quartile, q1, median, q3, n, iqr, whisker_low, whisker_high, outliers
FROM f JOIN w ON f.quartile = w.quartile""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]))
def q_error_quartile(spark, sf):
    """Q16 + Q18: absolute error box plot per predicted-severity quartile."""
    r = A.quantile_bins(_residuals(spark, sf), "predicted_severity", 4, ["Q1", "Q2", "Q3", "Q4"], out="quartile")
    return rounded(A.boxplot_stats(r, "quartile", "absolute_error"))


@register("boxplot_by_tier", rnd(with_views("trips") + "," + ENRICHED_SQL + "," + FULL_SQL + """,
dc AS (SELECT driver_id, CAST(sum(has_claim) AS BIGINT) AS had_claim_sum, sum(claim_amount) AS claim_amount_sum
       FROM trips GROUP BY driver_id),
b AS (SELECT risk_category, claim_amount_sum AS x FROM profiles JOIN dc USING (driver_id)
      WHERE had_claim_sum > 0 AND risk_category IS NOT NULL),
q AS (SELECT risk_category, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3, count(x) AS n FROM b GROUP BY risk_category),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
w AS (SELECT b.risk_category, min(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_low,
             max(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_high,
             count(*) FILTER (WHERE NOT (x >= lo AND x <= hi)) AS outliers
      FROM b JOIN f ON b.risk_category = f.risk_category GROUP BY b.risk_category)
SELECT f.risk_category, q1, median, q3, n, iqr, whisker_low, whisker_high, outliers
FROM f JOIN w ON f.risk_category = w.risk_category""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]))
def q_boxplot_tier(spark, sf):
    """Q18: box plot of claimants' claim amounts per driver risk category."""
    t = views.trips(spark, sf)
    prof = D.driver_profiles(FE.enrich_trips(t)).select("driver_id", "risk_category")
    claims = D.driver_claims(t).filter("had_claim_sum > 0")
    return rounded(A.boxplot_stats(prof.join(claims, "driver_id"), "risk_category", "claim_amount_sum"))
