"""R1-R11 scoring arithmetic, monitoring, and the J1-J7 joins around it.

All per-row work is one projection (no Python loop); summaries are single
aggregates; the baseline for drift is a 1-row table broadcast to the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.ids import content_ids
from ..functions.quantiles import exact_quantiles
from ..functions.scalar import cut, cut_rank, safe_div
from . import evaluation as V


def risk_score(p, sev) -> F.Column:
    """min(100 * (0.6 p + 0.4 min(sev / 50000, 1)), 100)."""
    norm = F.least(F.col(sev) / C.SEVERITY_CAP, F.lit(1.0)) if isinstance(sev, str) else F.least(sev / C.SEVERITY_CAP, F.lit(1.0))
    pc = F.col(p) if isinstance(p, str) else p
    return F.least((C.RISK_SCORE_P_WEIGHT * pc + C.RISK_SCORE_SEV_WEIGHT * norm) * 100, F.lit(100.0))


def risk_category(p) -> F.Column:
    """Left-closed probability categories."""
    return cut(p, C.RISK_CATEGORY_EDGES, C.RISK_CATEGORY_LABELS, closed="left")


def severity_uncertainty(sev) -> F.Column:
    """M9 closed form: 10 exact + 90 draws with 10 % Gaussian noise give a
    population std of 0.1 * sqrt(0.9) * prediction (deterministic, no draws)."""
    return (F.col(sev) if isinstance(sev, str) else sev) * (C.SEVERITY_NOISE_STD * math.sqrt(0.9))


def score_predictions(df: DataFrame, p: str = "claim_probability", sev: str = "claim_severity_prediction",
                      ids=("driver_id", "trip_id"), with_uncertainty: bool = True,
                      timestamp: bool = False) -> DataFrame:
    """R1 tail + R3-R5: expected amount, risk score, category, interval.
    Ids travel through the projection (never positional); R2: a missing
    trip_id is made from the row's content (`content_ids`): unique, and the same on every run."""
    if "trip_id" in ids and "trip_id" not in df.columns:
        df = content_ids(df, "trip_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})) \
            .withColumn("trip_id", F.concat(F.lit("trip_"), "trip_id"))
    cols = [c for c in ids if c in df.columns]
    out = [*cols, F.col(p).alias("claim_probability"), F.col(sev).alias("claim_severity_prediction"),
           (F.col(p) * F.col(sev)).alias("expected_claim_amount"),
           risk_score(p, sev).alias("risk_score"), risk_category(p).alias("risk_category"),
           cut_rank(p, C.RISK_CATEGORY_EDGES, closed="left").alias("risk_category_rank")]
    if with_uncertainty:
        u = severity_uncertainty(sev)
        out += [u.alias("severity_uncertainty"),
                F.greatest(F.lit(0.0), F.col(sev) - 2 * u).alias("confidence_interval_lower"),
                (F.col(sev) + 2 * u).alias("confidence_interval_upper")]
    if timestamp:
        out.append(F.current_timestamp().alias("prediction_timestamp"))
    return df.select(*out)


def premium(df: DataFrame, base_premium: float | str = 1000.0, p: str = "claim_probability",
            sev: str = "claim_severity_prediction") -> DataFrame:
    """Base * (1 + p * severity / 1000)."""
    base = F.col(base_premium) if isinstance(base_premium, str) else F.lit(float(base_premium))
    return df.select("*", (base * (1 + F.col(p) * F.col(sev) / 1000)).alias("premium"))


def prediction_summary(pred: DataFrame, approx_accuracy: int | None = None) -> DataFrame:
    """One-row summary of a prediction table (category counts are Q1)."""
    pcol, e, rs = F.col("claim_probability"), F.col("expected_claim_amount"), F.col("risk_score")
    qs = [0.25, 0.5, 0.75, 0.9, 0.95]
    q = (pred.agg(F.percentile_approx(pcol, qs, approx_accuracy).alias("__q")) if approx_accuracy
         else exact_quantiles(pred, "claim_probability", qs, out="__q"))
    a = pred.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(pcol).alias("p_mean"), F.stddev_samp(pcol).alias("p_std"), F.min(pcol).alias("p_min"),
        F.max(pcol).alias("p_max"),
        F.avg(e).alias("expected_mean"), F.stddev_samp(e).alias("expected_std"), F.min(e).alias("expected_min"),
        F.max(e).alias("expected_max"), F.sum(e).alias("expected_total"),
        F.avg(rs).alias("risk_score_mean"), F.stddev_samp(rs).alias("risk_score_std"),
        F.min(rs).alias("risk_score_min"), F.max(rs).alias("risk_score_max"),
        F.count_if(pcol > C.HIGH_RISK_PROBABILITY).alias("high_risk_count")).crossJoin(q)
    names = ["p_p25", "p_p50", "p_p75", "p_p90", "p_p95"]
    return a.select(*[c for c in a.columns if c != "__q"],
                    *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def high_risk(pred: DataFrame, threshold: float = C.HIGH_RISK_PROBABILITY) -> DataFrame:
    """Predictions above the probability threshold."""
    return pred.filter(F.col("claim_probability") > threshold)


def monitor(pred: DataFrame, by: str | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Totals, mean probability, high-risk ratio (optionally per group),
    with relative mean drift of probability and severity against a 1-row
    baseline (claim_probability_mean, severity_mean) broadcast to the rows."""
    g = pred.groupBy(by) if by else pred.groupBy()
    a = g.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("claim_probability").alias("avg_claim_probability"),
        F.avg((F.col("claim_probability") > C.HIGH_RISK_PROBABILITY).cast("double")).alias("high_risk_ratio"),
        F.avg("claim_severity_prediction").alias("avg_severity"))
    if baseline is None:
        return a
    d = a.crossJoin(F.broadcast(baseline.select("claim_probability_mean", "severity_mean")))
    return d.select(
        *a.columns,
        safe_div(F.abs(F.col("avg_claim_probability") - F.col("claim_probability_mean")),
                 F.col("claim_probability_mean")).alias("claim_probability_drift"),
        safe_div(F.abs(F.col("avg_severity") - F.col("severity_mean")), F.col("severity_mean")).alias("severity_drift"))


def baseline_stats(pred: DataFrame) -> DataFrame:
    """1-row baseline for `monitor`."""
    return pred.agg(F.avg("claim_probability").alias("claim_probability_mean"),
                    F.avg("claim_severity_prediction").alias("severity_mean"))


def live_performance(pred: DataFrame, claims: DataFrame, buckets: int | None = None, threshold: float = 0.5) -> DataFrame:
    """R9 + J2: predictions inner-join actual claims on trip_id, then claim
    rates, ROC-AUC, precision/recall at the threshold and severity RMSE/MAE
    on claims. AQE picks broadcast or sort-merge for the join from runtime
    sizes. Everything derives from ONE group-by of the joined rows per
    distinct score (counts and error sums ride along), so the join is
    computed once and the rest works on the small score table."""
    j = pred.join(claims.select("trip_id", "has_claim", "claim_amount"), "trip_id", "inner").select(
        F.col("has_claim").cast("int").alias("label"), F.col("claim_probability").alias("score"),
        "claim_amount", "claim_severity_prediction")
    is_claim = F.col("label") == 1
    err = F.col("claim_amount") - F.col("claim_severity_prediction")
    t = V.score_table(j, "label", "score", buckets, extra=[
        F.sum(F.when(is_claim, err * err)).alias("sq_err"), F.sum(F.when(is_claim, F.abs(err))).alias("abs_err")])
    hi = F.col("score") > threshold
    a = t.groupBy().agg(
        F.max("P").alias("P"), F.max("N").alias("N"),
        F.sum(F.when(hi, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hi, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("neg"))).alias("u"),
        F.sum("sq_err").alias("sq_err"), F.sum("abs_err").alias("abs_err"))
    n = F.col("P") + F.col("N")
    zero = F.lit(0.0)
    return a.filter(n > 0).select(
        (F.col("P") / n).alias("actual_claim_rate"),
        ((F.col("tp") + F.col("fp")) / n).alias("predicted_claim_rate"),
        n.alias("matched"),
        F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(safe_div(F.col("tp"), F.col("P")), zero).alias("recall"),
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).otherwise(zero)
        .alias("roc_auc"),
        F.sqrt(safe_div(F.col("sq_err"), F.col("P"))).alias("severity_rmse"),
        safe_div(F.col("abs_err"), F.col("P")).alias("severity_mae"))


def unscored(trips: DataFrame, scored: DataFrame, key: str = "trip_id") -> DataFrame:
    """Trips without a score yet (left anti join) for incremental scoring."""
    return trips.join(scored.select(key), key, "left_anti")


def with_claim_drivers(trips: DataFrame, key: str = "driver_id") -> DataFrame:
    """Trips of drivers that have at least one claim (left semi join)."""
    claimants = trips.filter(F.col("has_claim") == 1).select(key).distinct()
    return trips.join(claimants, key, "left_semi")


def prior_claim_risk(features: DataFrame) -> DataFrame:
    """Rule-based expected claim rate from trip features (the
    deterministic part of the reference's synthetic target)."""
    c = F.col
    r = ((c("hard_braking_count") > 2).cast("double") * 0.2 + (c("hard_acceleration_count") > 2).cast("double") * 0.2
         + (c("max_speed_kmh") > 120).cast("double") * 0.3 + (c("night_driving_minutes") > 20).cast("double") * 0.15
         + (c("phone_use_minutes") > 5).cast("double") * 0.15)
    mult = 1 + c("max_speed_kmh") / 200 + c("total_aggressive_events") / 10 + c("adverse_weather") * 0.5
    ids = [x for x in ("trip_id", "driver_id") if x in features.columns]
    return features.select(*ids, r.alias("prior_claim_risk"), mult.alias("severity_multiplier"))


def class_weight(df: DataFrame, label: str = "has_claim") -> DataFrame:
    """M4: n_negative / n_positive as a 1-row table (feeds weightCol)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive")) \
        .select("*", safe_div(F.col("n_negative"), F.col("n_positive")).alias("scale_pos_weight"))
