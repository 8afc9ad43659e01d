"""Scoring, monitoring and evaluation queries (R*, V*, J2/J6/J7, M4, M15) on `scored`."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import analytics as A
from ..operators import drivers as D
from ..operators import evaluation as V
from ..operators import features as FE
from ..operators import scoring as S
from ..sources.tables import checkpoint_dir, write_driver_aggregates, write_predictions, write_summary_json
from . import views
from .catalog import lit, register, rounded
from .oracle_sql import rnd
from .oracle_views import with_views
from .q_features import FEATS_WITH

U = C.SEVERITY_NOISE_STD * math.sqrt(0.9)
PRED_SQL = f"""
pred AS (
  SELECT driver_id, trip_id, claim_probability, claim_severity_prediction,
    claim_probability * claim_severity_prediction AS expected_claim_amount,
    least((0.6 * claim_probability + 0.4 * least(claim_severity_prediction / 50000.0, 1.0)) * 100, 100.0)
      AS risk_score,
    CASE WHEN claim_probability < 0.1 THEN 'Very Low' WHEN claim_probability < 0.25 THEN 'Low'
         WHEN claim_probability < 0.5 THEN 'Medium' WHEN claim_probability < 0.75 THEN 'High'
         WHEN claim_probability IS NOT NULL THEN 'Very High' END AS risk_category,
    CASE WHEN claim_probability < 0.1 THEN 1 WHEN claim_probability < 0.25 THEN 2
         WHEN claim_probability < 0.5 THEN 3 WHEN claim_probability < 0.75 THEN 4
         WHEN claim_probability IS NOT NULL THEN 5 END AS risk_category_rank,
    claim_severity_prediction * {lit(U)} AS severity_uncertainty,
    greatest(0.0, claim_severity_prediction - 2 * (claim_severity_prediction * {lit(U)}))
      AS confidence_interval_lower,
    claim_severity_prediction + 2 * (claim_severity_prediction * {lit(U)}) AS confidence_interval_upper
  FROM scored
)"""
PRED_DOUBLES = ["claim_probability", "claim_severity_prediction", "expected_claim_amount", "risk_score",
                "severity_uncertainty", "confidence_interval_lower", "confidence_interval_upper"]


def _pred(spark, sf):
    return S.score_predictions(views.scored(spark, sf))


@register("predictions", rnd(with_views("scored") + "," + PRED_SQL + "\nSELECT * FROM pred", PRED_DOUBLES))
def q_predictions(spark, sf):
    """Expected amount, 0-100 risk score, left-closed risk
    category and the severity confidence interval per trip."""
    return rounded(_pred(spark, sf))


@register("risk_category_distribution", rnd(with_views("scored") + "," + PRED_SQL + """
SELECT risk_category, count(*) AS trips, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM pred WHERE risk_category IS NOT NULL GROUP BY risk_category""", ["share_pct"]))
def q_risk_distribution(spark, sf):
    """Q1 + W4: trips and share per risk category."""
    vc = A.value_counts(_pred(spark, sf), "risk_category", "trips")
    # Window over the (<= 5 row) grouped table only.
    return rounded(vc.select("*", (F.col("trips") * 100.0 / F.sum("trips").over(Window.partitionBy())).alias(
        "share_pct")))


@register("premium", rnd(with_views("scored") + """
SELECT trip_id, 1000.0 * (1 + claim_probability * claim_severity_prediction / 1000) AS premium FROM scored""",
                         ["premium"]))
def q_premium(spark, sf):
    """Base premium 1000 scaled by 1 + p * severity / 1000."""
    return rounded(S.premium(views.scored(spark, sf), 1000.0).select("trip_id", "premium"))


SUMMARY_DOUBLES = ["p_mean", "p_std", "p_min", "p_max", "expected_mean", "expected_std", "expected_min",
                   "expected_max", "expected_total", "risk_score_mean", "risk_score_std", "risk_score_min",
                   "risk_score_max", "p_p25", "p_p50", "p_p75", "p_p90", "p_p95"]


@register("prediction_summary", rnd(with_views("scored") + "," + PRED_SQL + """
SELECT count(*) AS total_predictions,
  avg(claim_probability) AS p_mean, stddev_samp(claim_probability) AS p_std, min(claim_probability) AS p_min,
  max(claim_probability) AS p_max,
  avg(expected_claim_amount) AS expected_mean, stddev_samp(expected_claim_amount) AS expected_std,
  min(expected_claim_amount) AS expected_min, max(expected_claim_amount) AS expected_max,
  sum(expected_claim_amount) AS expected_total,
  avg(risk_score) AS risk_score_mean, stddev_samp(risk_score) AS risk_score_std, min(risk_score) AS risk_score_min,
  max(risk_score) AS risk_score_max,
  count(*) FILTER (WHERE claim_probability > 0.5) AS high_risk_count,
  quantile_cont(claim_probability, 0.25) AS p_p25, quantile_cont(claim_probability, 0.5) AS p_p50,
  quantile_cont(claim_probability, 0.75) AS p_p75, quantile_cont(claim_probability, 0.9) AS p_p90,
  quantile_cont(claim_probability, 0.95) AS p_p95
FROM pred""", SUMMARY_DOUBLES))
def q_prediction_summary(spark, sf):
    """One-row statistics of a prediction batch."""
    return rounded(S.prediction_summary(_pred(spark, sf)))


@register("named_sinks", with_views("scored") + """
SELECT 'drivers' AS sink, count(DISTINCT driver_id) AS rows, count(driver_id) AS trips, CAST(sum(driver_id) AS BIGINT) AS key_sum FROM trips
UNION ALL SELECT 'predictions', count(*), count(*), CAST(sum(trip_id) AS BIGINT) FROM scored
UNION ALL SELECT 'summary', 1, count(*), CAST(sum(CAST(claim_probability > 0.5 AS INTEGER)) AS BIGINT) FROM scored""")
def q_named_sinks(spark, sf):
    """Driver table, predictions and their summary written, read back and counted
    (key_sum: driver of every trip, trip ids, high-risk trips)."""
    base = os.path.join(checkpoint_dir(spark), "sinks", uuid.uuid4().hex)
    at = {n: os.path.join(base, n) for n in ("drivers", "predictions", "summary")}
    write_driver_aggregates(D.driver_features_basic(views.trips(spark, sf)), at["drivers"])
    write_predictions(_pred(spark, sf), at["predictions"])
    write_summary_json(S.prediction_summary(spark.read.parquet(at["predictions"])), at["summary"])
    row = lambda df, name, *cols: df.agg(*cols).select(
        F.lit(name).alias("sink"), *[F.col(c).cast("long").alias(c) for c in ("rows", "trips", "key_sum")])
    n = F.count(F.lit(1))
    return row(spark.read.parquet(at["drivers"]), "drivers", n.alias("rows"), F.sum("total_trips").alias("trips"),
               F.sum(F.col("driver_id") * F.col("total_trips")).alias("key_sum")) \
        .unionByName(row(spark.read.parquet(at["predictions"]), "predictions", n.alias("rows"), n.alias("trips"), F.sum("trip_id").alias("key_sum"))) \
        .unionByName(row(spark.read.json(at["summary"]), "summary", n.alias("rows"), F.sum("total_predictions").alias("trips"),
                         F.sum("high_risk_count").alias("key_sum")))


@register("high_risk_report", rnd(with_views("scored") + "," + PRED_SQL + """
SELECT driver_id, trip_id, claim_probability, expected_claim_amount FROM pred WHERE claim_probability > 0.5""",
                                  ["claim_probability", "expected_claim_amount"]))
def q_high_risk(spark, sf):
    """Trips above the 0.5 probability threshold."""
    return rounded(S.high_risk(_pred(spark, sf)).select("driver_id", "trip_id", "claim_probability",
                                                        "expected_claim_amount"))


@register("prediction_drift", rnd(with_views("scored") + """,
base AS (SELECT avg(claim_probability) AS claim_probability_mean, avg(claim_severity_prediction) AS severity_mean
         FROM scored),
g AS (SELECT time_of_day, count(*) AS total_predictions, avg(claim_probability) AS avg_claim_probability,
             avg(CAST(claim_probability > 0.5 AS DOUBLE)) AS high_risk_ratio,
             avg(claim_severity_prediction) AS avg_severity
      FROM scored GROUP BY time_of_day)
SELECT g.*, abs(avg_claim_probability - claim_probability_mean) / claim_probability_mean AS claim_probability_drift,
  abs(avg_severity - severity_mean) / severity_mean AS severity_drift
FROM g CROSS JOIN base""", ["avg_claim_probability", "high_risk_ratio", "avg_severity", "claim_probability_drift",
                             "severity_drift"]))
def q_prediction_drift(spark, sf):
    """Per time-of-day monitoring with relative mean drift against the
    overall baseline (1-row table, broadcast)."""
    sc = views.scored(spark, sf)
    return rounded(S.monitor(sc, by="time_of_day", baseline=S.baseline_stats(sc)))


@register("live_performance", rnd(with_views("scored") + """,
st AS (SELECT claim_probability AS score, CAST(sum(has_claim) AS BIGINT) AS pos,
              CAST(sum(1 - has_claim) AS BIGINT) AS neg FROM scored GROUP BY claim_probability),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM st),
auc AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(pos * ((cum_neg - neg) + 0.5 * neg)) / (sum(pos) * sum(neg)) ELSE 0.0 END AS roc_auc
        FROM cum),
j AS (SELECT has_claim AS label, claim_probability, CAST(claim_probability > 0.5 AS INTEGER) AS prediction,
             claim_amount, claim_severity_prediction FROM scored),
m AS (SELECT avg(label) AS actual_claim_rate, avg(prediction) AS predicted_claim_rate, count(*) AS matched,
        coalesce(CASE WHEN count(*) FILTER (WHERE prediction = 1) > 0 THEN
          count(*) FILTER (WHERE label = 1 AND prediction = 1) / count(*) FILTER (WHERE prediction = 1) END, 0.0)
          AS precision,
        coalesce(CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN
          count(*) FILTER (WHERE label = 1 AND prediction = 1) / count(*) FILTER (WHERE label = 1) END, 0.0) AS recall,
        sqrt(avg(pow(claim_amount - claim_severity_prediction, 2)) FILTER (WHERE label = 1)) AS severity_rmse,
        avg(abs(claim_amount - claim_severity_prediction)) FILTER (WHERE label = 1) AS severity_mae
      FROM j)
SELECT actual_claim_rate, predicted_claim_rate, matched, precision, recall, roc_auc, severity_rmse, severity_mae
FROM m CROSS JOIN auc WHERE matched > 0""", ["actual_claim_rate", "predicted_claim_rate", "precision", "recall",
                                            "roc_auc", "severity_rmse", "severity_mae"]))
def q_live_performance(spark, sf):
    """R9 + J2: predictions joined to actual claims on trip_id, then rates,
    AUC, precision/recall at 0.5 and severity errors on claims."""
    sc = views.scored(spark, sf)
    pred = sc.select("trip_id", "claim_probability", "claim_severity_prediction")
    claims = sc.select("trip_id", "has_claim", "claim_amount")
    return rounded(S.live_performance(pred, claims))


@register("incremental_unscored", with_views("trips") + """
SELECT t.trip_id, t.driver_id, t.trip_date FROM trips t
WHERE NOT EXISTS (SELECT 1 FROM trips s WHERE s.trip_date < TIMESTAMP '1997-01-01' AND s.trip_id = t.trip_id)""")
def q_unscored(spark, sf):
    """Trips without a score yet (left anti join against the batch
    scored up to 1997-01-01)."""
    t = views.trips(spark, sf)
    done = views.scored(spark, sf).filter(F.col("trip_date") < F.lit("1997-01-01").cast("timestamp"))
    return S.unscored(t, done).select("trip_id", "driver_id", "trip_date")


@register("claim_drivers", with_views("trips") + """
SELECT trip_id, driver_id FROM trips t
WHERE EXISTS (SELECT 1 FROM trips c WHERE c.has_claim = 1 AND c.driver_id = t.driver_id)""")
def q_claim_drivers(spark, sf):
    """Trips of drivers with at least one claim (left semi join)."""
    return S.with_claim_drivers(views.trips(spark, sf)).select("trip_id", "driver_id")


EVAL_BASE = with_views("scored") + """,
ev AS (SELECT has_claim AS label, claim_probability AS score, CAST(claim_probability > 0.5 AS INTEGER) AS prediction
       FROM scored)"""
CM_SQL = """
cm AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM ev)"""


def _ev(spark, sf):
    return views.scored(spark, sf).select(
        F.col("has_claim").alias("label"), F.col("claim_probability").alias("score"),
        (F.col("claim_probability") > C.HIGH_RISK_PROBABILITY).cast("int").alias("prediction"))


@register("confusion_matrix", EVAL_BASE + "," + CM_SQL + "\nSELECT tn, fp, fn, tp FROM cm")
def q_confusion(spark, sf):
    """V1: tn/fp/fn/tp at the 0.5 threshold."""
    return V.confusion_matrix(_ev(spark, sf))


def _zd(n, d):
    return f"coalesce(CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) END, 0.0)"


@register("classification_metrics", rnd(EVAL_BASE + "," + CM_SQL + f""",
pr AS (SELECT *, {_zd('tp', 'tp + fp')} AS precision, {_zd('tp', 'tp + fn')} AS recall FROM cm)
SELECT tn, fp, fn, tp, {_zd('tp + tn', 'tp + tn + fp + fn')} AS accuracy, precision, recall,
  {_zd('2 * precision * recall', 'precision + recall')} AS f1 FROM pr""", ["accuracy", "precision", "recall", "f1"]))
def q_class_metrics(spark, sf):
    """V2: accuracy, precision, recall, F1 (zero division -> 0)."""
    return rounded(V.classification_metrics(_ev(spark, sf)))


@register("classification_report", rnd(EVAL_BASE + "," + CM_SQL + f""",
per AS (
  SELECT '0' AS class_label, {_zd('tn', 'tn + fn')} AS precision, {_zd('tn', 'tn + fp')} AS recall,
    CAST(tn + fp AS BIGINT) AS support FROM cm
  UNION ALL
  SELECT '1', {_zd('tp', 'tp + fp')}, {_zd('tp', 'tp + fn')}, CAST(tp + fn AS BIGINT) FROM cm
),
per2 AS (SELECT *, {_zd('2 * precision * recall', 'precision + recall')} AS f1 FROM per)
SELECT * FROM per2
UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), CAST(sum(support) AS BIGINT), avg(f1) FROM per2
UNION ALL
SELECT 'weighted avg', {_zd('sum(precision * support)', 'sum(support)')}, {_zd('sum(recall * support)', 'sum(support)')},
  CAST(sum(support) AS BIGINT), {_zd('sum(f1 * support)', 'sum(support)')} FROM per2""", ["precision", "recall", "f1"]))
def q_class_report(spark, sf):
    """V7: per-class precision/recall/F1/support with macro and weighted rows."""
    return rounded(V.classification_report(_ev(spark, sf)))


SCORE_TABLE_SQL = """
st AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
       FROM ev WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_pos,
               sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM st),
tot AS (SELECT CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM st),
ct AS (SELECT * FROM cum CROSS JOIN tot)"""


@register("roc_auc", rnd(EVAL_BASE + "," + SCORE_TABLE_SQL + """
SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * ((cum_neg - neg) + 0.5 * neg)) / (max(P) * max(N))
            ELSE 0.0 END AS roc_auc, max(P) AS positives, max(N) AS negatives FROM ct""", ["roc_auc"]))
def q_roc_auc(spark, sf):
    """V3: exact ROC-AUC with ties counted half (distributed prefix sums)."""
    return rounded(V.roc_auc(_ev(spark, sf)))


@register("average_precision", rnd(EVAL_BASE + "," + SCORE_TABLE_SQL + """,
pts AS (SELECT *, P - (cum_pos - pos) AS tp, N - (cum_neg - neg) AS fp FROM ct)
SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos / P * (tp / (tp + fp))) ELSE 0.0 END AS average_precision
FROM pts""", ["average_precision"]))
def q_average_precision(spark, sf):
    """V4: step-form average precision."""
    return rounded(V.average_precision(_ev(spark, sf)))


CURVE_SQL = f""",
pts AS (SELECT *, P - (cum_pos - pos) AS tp, N - (cum_neg - neg) AS fp FROM ct),
curve AS (SELECT score AS threshold, tp, fp, {_zd('tp', 'P')} AS tpr, {_zd('fp', 'N')} AS fpr,
                 {_zd('tp', 'tp + fp')} AS precision, {_zd('tp', 'P')} AS recall FROM pts)"""


@register("roc_curve_points", rnd(EVAL_BASE + "," + SCORE_TABLE_SQL + CURVE_SQL + "\nSELECT * FROM curve",
                                  ["threshold", "tpr", "fpr", "precision", "recall"]))
def q_curve(spark, sf):
    """V6: ROC / PR curve points per distinct threshold."""
    return rounded(V.curve_points(_ev(spark, sf)))


@register("pr_auc_trapezoid", rnd(EVAL_BASE + "," + SCORE_TABLE_SQL + CURVE_SQL + """
SELECT sum((recall - coalesce(r_hi, 0.0)) * (precision + coalesce(p_hi, 1.0)) / 2) AS pr_auc
FROM (SELECT *, lead(recall) OVER (ORDER BY threshold) AS r_hi, lead(precision) OVER (ORDER BY threshold) AS p_hi
      FROM curve)""", ["pr_auc"]))
def q_pr_auc(spark, sf):
    """V5: trapezoid area under the precision-recall points."""
    return rounded(V.pr_auc_trapezoid(_ev(spark, sf)))


REG_BASE = with_views("scored") + """,
rg AS (SELECT claim_amount AS actual, claim_severity_prediction AS predicted FROM scored WHERE has_claim = 1)"""


def _rg(spark, sf):
    return views.scored(spark, sf).filter("has_claim = 1").select(
        F.col("claim_amount").alias("actual"), F.col("claim_severity_prediction").alias("predicted"))


@register("regression_metrics", rnd(REG_BASE + """
SELECT count(*) AS n, sqrt(sum((actual - predicted) * (actual - predicted)) / count(*)) AS rmse,
  avg(abs(actual - predicted)) AS mae,
  1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2,
  CASE WHEN count(*) FILTER (WHERE actual = 0) = 0 THEN avg(abs(actual - predicted) / abs(actual)) END AS mape
FROM rg""", ["rmse", "mae", "r2", "mape"]))
def q_regression(spark, sf):
    """V8: RMSE, MAE, R^2, MAPE of severity on claims."""
    return rounded(V.regression_metrics(_rg(spark, sf)))


@register("error_percentiles", rnd(REG_BASE + """
SELECT quantile_cont(abs(actual - predicted), 0.5) AS median_error,
  quantile_cont(abs(actual - predicted), 0.9) AS p90_error,
  quantile_cont(abs(actual - predicted), 0.95) AS p95_error FROM rg""", ["median_error", "p90_error", "p95_error"]))
def q_error_pct(spark, sf):
    """V9: median / p90 / p95 absolute error."""
    return rounded(V.error_percentiles(_rg(spark, sf)))


@register("prior_claim_risk", rnd(FEATS_WITH + """
SELECT trip_id, driver_id,
  CAST(hard_braking_count > 2 AS DOUBLE) * 0.2 + CAST(hard_acceleration_count > 2 AS DOUBLE) * 0.2
  + CAST(max_speed_kmh > 120 AS DOUBLE) * 0.3 + CAST(night_driving_minutes > 20 AS DOUBLE) * 0.15
  + CAST(phone_use_minutes > 5 AS DOUBLE) * 0.15 AS prior_claim_risk,
  1 + max_speed_kmh / 200 + total_aggressive_events / 10 + adverse_weather * 0.5 AS severity_multiplier
FROM feats""", ["prior_claim_risk", "severity_multiplier"]))
def q_prior_claim_risk(spark, sf):
    """Rule-based expected claim rate and severity multiplier."""
    f = FE.create_features(views.trip_inputs_metric(views.trips(spark, sf)))
    return rounded(S.prior_claim_risk(f))


@register("class_weight", rnd(with_views("trips") + """
SELECT count(*) FILTER (WHERE has_claim = 0) AS n_negative, count(*) FILTER (WHERE has_claim = 1) AS n_positive,
  CASE WHEN count(*) FILTER (WHERE has_claim = 1) <> 0
       THEN count(*) FILTER (WHERE has_claim = 0) / count(*) FILTER (WHERE has_claim = 1) END AS scale_pos_weight
FROM trips""", ["scale_pos_weight"]))
def q_class_weight(spark, sf):
    """M4: negative / positive ratio for the classifier weight."""
    return rounded(S.class_weight(views.trips(spark, sf)))


@register("risk_score", rnd(with_views("scored") + "," + PRED_SQL + "\nSELECT trip_id, risk_score FROM pred",
                            ["risk_score"]))
def q_risk_score(spark, sf):
    """0-100 risk score from probability and capped severity."""
    return rounded(_pred(spark, sf).select("trip_id", "risk_score"))


@register("risk_category", with_views("scored") + "," + PRED_SQL
          + "\nSELECT trip_id, risk_category, risk_category_rank FROM pred")
def q_risk_category(spark, sf):
    """Left-closed probability categories with their order."""
    return _pred(spark, sf).select("trip_id", "risk_category", "risk_category_rank")


@register("confidence_interval", rnd(with_views("scored") + "," + PRED_SQL + """
SELECT trip_id, severity_uncertainty, confidence_interval_lower, confidence_interval_upper FROM pred""",
                                     ["severity_uncertainty", "confidence_interval_lower", "confidence_interval_upper"]))
def q_confidence_interval(spark, sf):
    """Severity uncertainty and the 2-sigma interval floored at 0."""
    return rounded(_pred(spark, sf).select("trip_id", "severity_uncertainty", "confidence_interval_lower",
                                           "confidence_interval_upper"))
