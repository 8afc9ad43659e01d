"""Classification and regression evaluation as aggregates.

ROC-AUC and average precision are exact (ties count half / step form) and
never put all rows in one task: rows are first reduced to one row per
distinct score (pos/neg counts), then running sums come from
``ranged_prefix_sums`` (ranges by the data's size + broadcast offsets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import ranged_prefix_sums
from ..functions.quantiles import exact_quantiles
from ..functions.scalar import safe_div


def _zero_div(num, den):
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V1: tn, fp, fn, tp in one aggregate."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V2: accuracy, precision, recall, F1 (zero division -> 0)."""
    cm = confusion_matrix(df, label, pred)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _zero_div(tp, tp + fp), _zero_div(tp, tp + fn)
    return cm.select(
        "tn", "fp", "fn", "tp",
        _zero_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        _zero_div(2 * prec * rec, prec + rec).alias("f1"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V7: per-class precision/recall/F1/support plus macro and weighted rows."""
    cm = confusion_matrix(df, label, pred)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def row(name, t, f_p, f_n, support):
        p, r = _zero_div(t, t + f_p), _zero_div(t, t + f_n)
        return F.struct(F.lit(name).alias("class_label"), p.alias("precision"), r.alias("recall"),
                        _zero_div(2 * p * r, p + r).alias("f1"), support.cast("long").alias("support"))

    per = cm.select(F.inline(F.array(row("0", tn, fn, fp, tn + fp), row("1", tp, fp, fn, tp + fn))))
    tot = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _zero_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _zero_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _zero_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        F.sum("support").alias("n"))
    avg_rows = tot.select(F.inline(F.array(
        F.struct(F.lit("macro avg").alias("class_label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class_label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")))))
    return per.unionByName(avg_rows)


def score_table(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None,
                extra: list | None = None) -> DataFrame:
    """One row per distinct score with pos/neg counts and inclusive
    ascending running sums (cum_pos, cum_neg) plus global totals. `extra`
    aggregates ride along in the same group-by (one pass over the rows).

    The per-score table is sorted into ranges and checkpointed once (shared
    folder), so the input pipeline runs once; ``buckets`` fixes the number of ranges."""
    y = F.col(label).cast("long")
    s = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), *(extra or []))
    return ranged_prefix_sums(s, "score", ["pos", "neg"], buckets).withColumnsRenamed({"total_pos": "P", "total_neg": "N"})


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None,
            table: DataFrame | None = None) -> DataFrame:
    """V3: exact ROC-AUC, ties count half; 0.0 when only one class is present. ``table``: the `score_table`
    of these rows, where several measures share it."""
    t = table if table is not None else score_table(df, label, score, buckets)
    below = F.col("cum_neg") - F.col("neg")
    contrib = F.col("pos") * (below + 0.5 * F.col("neg"))
    return t.groupBy().agg(F.sum(contrib).alias("u"), F.max("P").alias("P"), F.max("N").alias("N")).select(
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).otherwise(F.lit(0.0))
        .alias("roc_auc"),
        F.col("P").alias("positives"), F.col("N").alias("negatives"))


def curve_points(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """V6: per distinct threshold (predict 1 when score >= threshold):
    tp, fp, tpr, fpr, precision, recall."""
    t = score_table(df, label, score, buckets)
    tp = F.col("P") - (F.col("cum_pos") - F.col("pos"))
    fp = F.col("N") - (F.col("cum_neg") - F.col("neg"))
    return t.select(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        _zero_div(tp, F.col("P")).alias("tpr"), _zero_div(fp, F.col("N")).alias("fpr"),
        _zero_div(tp, tp + fp).alias("precision"), _zero_div(tp, F.col("P")).alias("recall"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None,
                      table: DataFrame | None = None) -> DataFrame:
    """V4: step-form average precision sum(dR * P); 0.0 for one class. ``table`` as in `roc_auc`."""
    t = table if table is not None else score_table(df, label, score, buckets)
    tp = F.col("P") - (F.col("cum_pos") - F.col("pos"))
    fp = F.col("N") - (F.col("cum_neg") - F.col("neg"))
    contrib = F.col("pos") / F.col("P") * (tp / (tp + fp))
    return t.groupBy().agg(F.sum(contrib).alias("ap"), F.max("P").alias("P"), F.max("N").alias("N")).select(
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("ap")).otherwise(F.lit(0.0)).alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """V5: trapezoid area under the precision-recall points (thresholds
    descending, starting at recall 0 / precision 1)."""
    pts = curve_points(df, label, score, buckets)
    # Trapezoid between consecutive thresholds: neighbours in descending score
    # order are neighbours in the ascending prefix table, joined on rank.
    ranked = ranged_prefix_sums(pts.withColumn("one", F.lit(1)), "threshold", ["one"], buckets, prefix="rank_")
    prev = ranked.select((F.col("rank_one") - 1).alias("rank_one"), F.col("recall").alias("r_hi"),
                         F.col("precision").alias("p_hi"))
    j = ranked.join(prev, "rank_one", "left")
    r_hi = F.coalesce("r_hi", F.lit(0.0))
    p_hi = F.coalesce("p_hi", F.lit(1.0))
    area = (F.col("recall") - r_hi) * (F.col("precision") + p_hi) / 2
    return j.agg(F.sum(area).alias("pr_auc"))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """V8: RMSE, MAE, R^2, MAPE (NULL when any actual is 0), one aggregate."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    a = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("var_y"), F.count_if(y == 0).alias("zeros"),
        F.avg(safe_div(F.abs(e), F.abs(y))).alias("mape_raw"))
    return a.select(
        "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae",
        (1 - safe_div(F.col("sse"), F.col("var_y") * F.col("n"))).alias("r2"),
        F.when(F.col("zeros") == 0, F.col("mape_raw")).alias("mape"))


def error_percentiles(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                      approx_accuracy: int | None = None) -> DataFrame:
    """V9: median, p90, p95 of the absolute error (exact, distributed)."""
    e = F.abs(F.col(actual) - F.col(predicted))
    if approx_accuracy:
        q = df.agg(F.percentile_approx(e, [0.5, 0.9, 0.95], approx_accuracy).alias("quantiles"))
    else:
        q = exact_quantiles(df, e, [0.5, 0.9, 0.95])
    return q.select(F.col("quantiles")[0].alias("median_error"), F.col("quantiles")[1].alias("p90_error"),
                    F.col("quantiles")[2].alias("p95_error"))
