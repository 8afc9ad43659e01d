"""Q1-Q23: exploratory and segment analytics.

Global statistics (quantile edges, min/max, overall rates) are always a
1-row aggregate cross-joined with a broadcast (J5); group outputs are small
by construction (categories, bins). Exact percentiles hold a value->count
map per group; pass ``approx_accuracy`` to switch to ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from ..functions.quantiles import exact_quantile, exact_quantiles
from ..functions.scalar import cut, cut_rank, flag, safe_div

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _pct(c, p, approx_accuracy=None) -> Column:
    if approx_accuracy:
        return F.percentile_approx(c, p, approx_accuracy)
    return F.percentile(c, p)


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Q1: counts per value; NULL values are dropped like pandas."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """Q2/Q3: the k most frequent key combinations, ties broken by key."""
    keys = list(keys)
    return (df.filter(F.greatest(*[F.col(c).isNull() for c in keys]) == F.lit(False)) if len(keys) > 1
            else df.filter(F.col(keys[0]).isNotNull())) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("trips")) \
        .orderBy(F.desc("trips"), *keys).limit(k)


def top_n_rows(df: DataFrame, by: str, n: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """Q4: nlargest — TakeOrderedAndProject, no full sort."""
    return df.orderBy(F.desc(by), *tie).limit(n)


def describe(df: DataFrame, columns: Sequence[str], approx_accuracy: int | None = None) -> DataFrame:
    """Q7: count/mean/std/min/quartiles/max for each column, one row per
    column: unpivot, one group-by keyed by column name, and exact quartiles
    per column from the distributed quantile operator (no per-column value
    map in one task)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(pairs))
    x = F.col("x")
    st = long.groupBy("column_name").agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                                         F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = _grouped_quartiles(long, "x", ["column_name"], approx_accuracy)
    return st.join(q, "column_name", "left").select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75",
                                                     "max")


def _grouped_quartiles(df: DataFrame, column: str, by: list[str], approx_accuracy: int | None = None,
                       probs=(0.25, 0.5, 0.75), names=("p25", "p50", "p75")) -> DataFrame:
    if approx_accuracy:
        q = df.groupBy(*by).agg(F.percentile_approx(column, list(probs), approx_accuracy).alias("__q"))
    else:
        q = exact_quantiles(df, column, probs, out="__q", by=by)
    return q.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def label_table(spark, labels: Sequence[str], name: str, rank: str = "bin_rank") -> DataFrame:
    """Small fixed label dimension built JVM-side (no Python data transfer)."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias(rank), F.lit(lab).alias(name)) for i, lab in enumerate(labels)])
    return spark.range(1).select(F.inline(rows))


def group_means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Q8: mean of columns per category (NULL category dropped)."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])


def time_of_day_rates(trips: DataFrame) -> DataFrame:
    """Q8/Q9: per time of day, trips, mean speed and phone-use rate (%)."""
    return trips.filter(F.col("time_of_day").isNotNull()).groupBy("time_of_day").agg(
        F.count(F.lit(1)).alias("trips"),
        F.avg("average_speed_mph").alias("average_speed_mph_mean"),
        (F.avg(flag(F.col("phone_usage_seconds") > 0).cast("double")) * 100).alias("phone_usage_rate_pct"),
    )


def weekday_profile(trips: DataFrame, date_col: str = "trip_date") -> DataFrame:
    """Q10: Monday..Sunday, absent days kept as empty rows (7-row dimension
    left-joined to the aggregate)."""
    spark = trips.sparkSession
    days = label_table(spark, WEEKDAYS, "day_of_week", "day_order")
    total = F.col("harsh_braking_events") + F.col("harsh_acceleration_events") + F.col("sharp_cornering_events")
    agg = (trips.select(F.date_format(date_col, "EEEE").alias("day_of_week"), "distance_miles",
                        total.alias("total_harsh_events"))
           .groupBy("day_of_week").agg(F.count(F.lit(1)).alias("trips"),
                                       F.avg("distance_miles").alias("distance_miles_mean"),
                                       F.avg("total_harsh_events").alias("total_harsh_events_mean")))
    return agg.join(F.broadcast(days), "day_of_week", "right").select(
        "day_order", "day_of_week", F.coalesce("trips", F.lit(0)).alias("trips"),
        "distance_miles_mean", "total_harsh_events_mean")


def predicate_rates(trips: DataFrame) -> DataFrame:
    """Q6/Q11: dataset overview and behaviour rates in one aggregate."""
    total = F.col("harsh_braking_events") + F.col("harsh_acceleration_events") + F.col("sharp_cornering_events")

    def rate(cond):
        return F.avg(flag(cond).cast("double")) * 100

    return trips.agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.count_distinct("driver_id").alias("unique_drivers"),
        (F.count(F.lit(1)) / F.count_distinct("driver_id")).alias("trips_per_driver"),
        F.avg("duration_minutes").alias("avg_duration_minutes"),
        F.avg("distance_miles").alias("avg_distance_miles"),
        F.avg("average_speed_mph").alias("avg_speed_mph"),
        (F.avg("night_driving") * 100).alias("night_rate_pct"),
        (F.avg("rush_hour") * 100).alias("rush_rate_pct"),
        rate(F.col("harsh_braking_events") > 0).alias("braking_rate_pct"),
        rate(F.col("harsh_acceleration_events") > 0).alias("acceleration_rate_pct"),
        rate(F.col("phone_usage_seconds") > 0).alias("phone_rate_pct"),
        rate(F.col("speeding_percent") > 0).alias("speeding_rate_pct"),
        F.avg(total).alias("avg_harsh_events"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q13: Pearson r for every ordered pair, computed once per unordered pair.

    Rows are unpivoted to (pair, a, b) and folded by pair before the shuffle:
    one ``corr`` buffer a pair and task, in whole-stage codegen, where one
    ``corr`` column for each pair would be a row of hundreds of buffers."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    itself = label_table(df.sparkSession, columns, "x").select("x", F.col("x").alias("y"), F.lit(1.0).alias("r"))
    if not pairs:
        return itself
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        for i, (a, b) in enumerate(pairs)])))
    # without rows every pair still has its (null) row
    known = df.sparkSession.range(1).select(F.posexplode(names).alias("pair", "p")).select("pair", "p.x", "p.y")
    r = known.join(values.groupBy("pair").agg(F.corr("a", "b").alias("r")), "pair", "left")
    both = F.array(F.struct("x", "y", "r"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    return r.select(F.inline(both)).unionByName(itself)


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Q14: degree-1 least squares fit y = slope * x + intercept."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def labelled_bins(df: DataFrame, column: str, edges, labels, out: str, closed: str = "right") -> DataFrame:
    """Q15: fixed-edge bin label + rank."""
    return df.select("*", cut(column, edges, labels, closed).alias(out),
                     cut_rank(column, edges, closed).alias(f"{out}_rank"))


def bin_counts(binned: DataFrame, out: str, labels: Sequence[str]) -> DataFrame:
    """Counts per bin label, empty bins included (label dimension left join)."""
    spark = binned.sparkSession
    dim = label_table(spark, labels, out)
    agg = binned.filter(F.col(out).isNotNull()).groupBy(out).agg(F.count(F.lit(1)).alias("n"))
    return agg.join(F.broadcast(dim), out, "right").select("bin_rank", out, F.coalesce("n", F.lit(0)).alias("n"))


def quantile_edges(df: DataFrame, column: str, q: int, approx_accuracy: int | None = None) -> DataFrame:
    """1-row table of the q+1 quantile edges (linear interpolation), exact
    and distributed (functions/quantiles.py) unless an accuracy is given."""
    probs = [i / q for i in range(q + 1)]
    if approx_accuracy:
        return df.agg(F.percentile_approx(F.col(column), probs, approx_accuracy).alias("__edges"))
    return exact_quantiles(df, column, probs, out="__edges")


def quantile_bins(df: DataFrame, column: str, q: int, labels: Sequence[str] | None = None, out: str = "tier",
                  approx_accuracy: int | None = None) -> DataFrame:
    """Q16: qcut — right-closed bins on exact quantile edges, lowest value
    included; ties always share a bin (unlike ntile). Duplicate edges leave
    empty bins (the reference raises instead)."""
    labels = list(labels or [f"Q{i + 1}" for i in range(q)])
    e = quantile_edges(df, column, q, approx_accuracy)
    d = df.crossJoin(F.broadcast(e))
    x = F.col(column)
    rank = None
    for i in range(1, q + 1):
        cond = x <= F.col("__edges")[i]
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
    rank = F.when(x.isNull(), None).otherwise(rank)
    lab = F.element_at(F.array(*[F.lit(s) for s in labels]), rank)
    return d.select(*df.columns, rank.alias(f"{out}_rank"), lab.alias(out))


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Q17: equal-width bins over the global [min, max] (max falls in the
    last bin), counts and density (per group when `by` is given, each group's
    density over its own count), empty bins included."""
    x = F.col(column).cast("double")
    mm = df.agg(F.min(x).alias("__mn"), F.max(x).alias("__mx"))
    keys = [by] if by else []
    d = df.select(*keys, x.alias("__x")).filter(F.col("__x").isNotNull()).crossJoin(F.broadcast(mm))
    width = (F.col("__mx") - F.col("__mn"))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__mn")) / width * bins), F.lit(bins - 1))).cast("int")
    counts = d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("__n"))
    spark = df.sparkSession
    # dimension: bins x groups (both small: #bins rows times #groups)
    # bins x groups: the output grid itself (totals has one row per group,
    # so it is left to AQE instead of a forced broadcast)
    dim = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(mm)) \
        .crossJoin(totals)
    w = (F.col("__mx") - F.col("__mn")) / bins
    return dim.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("__mn") + F.col("bin") * w).alias("bin_start"),
        (F.col("__mn") + (F.col("bin") + 1) * w).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
        safe_div(F.coalesce("count", F.lit(0)), F.col("__n") * w).alias("density"),
    )


def boxplot_stats(df: DataFrame, by: str, column: str, approx_accuracy: int | None = None) -> DataFrame:
    """Q18: quartiles, 1.5 IQR whiskers and outlier count per group."""
    x = F.col(column).cast("double")
    base = df.filter(F.col(by).isNotNull()).select(by, x.alias("__x"))
    q = _grouped_quartiles(base, "__x", [by], approx_accuracy, names=("q1", "median", "q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
    q = broadcast_if_small(q)  # one row per group
    j = base.join(q, by)
    inside = (F.col("__x") >= F.col("lo_fence")) & (F.col("__x") <= F.col("hi_fence"))
    return j.groupBy(by, "q1", "median", "q3", "iqr").agg(
        F.count("__x").alias("n"),
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers")) \
        .select(by, "q1", "median", "q3", "n", "iqr", "whisker_low", "whisker_high", "outliers")


def above_quantile(df: DataFrame, column: str, q: float, approx_accuracy: int | None = None) -> DataFrame:
    """Q12: rows strictly above the q-quantile of `column` (1-row threshold, broadcast)."""
    t = (df.agg(F.percentile_approx(F.col(column), q, approx_accuracy).alias("__thr")) if approx_accuracy
         else exact_quantile(df, column, q, out="__thr"))
    return df.crossJoin(F.broadcast(t)).filter(F.col(column) > F.col("__thr")).drop("__thr")


SEGMENT_EDGES = (0.0, 0.1, 0.2, 0.3, 1.0)
SEGMENT_LABELS = ("Low Risk", "Medium Risk", "High Risk", "Very High Risk")
SEVERITY_EDGES = (0.0, 2000.0, 5000.0, 10000.0, float("inf"))
SEVERITY_LABELS = ("Low Severity", "Medium Severity", "High Severity", "Very High Severity")


def segment_lift(scored: DataFrame, prob: str = "claim_probability", actual: str = "has_claim",
                 edges=SEGMENT_EDGES, labels=SEGMENT_LABELS, id_col: str = "driver_id") -> DataFrame:
    """Q19: per right-closed probability segment: count, actual claims, claim
    rate, mean/std probability, lift = rate / overall rate. Empty segments
    are listed; rows outside all segments still count in the overall rate.

    One scan: the group-by keeps the NULL (outside) segment so the overall
    rate comes from the grouped table itself (<= #segments + 1 rows)."""
    spark = scored.sparkSession
    seg = cut(prob, edges, labels)
    g = scored.select(seg.alias("risk_segment"), id_col, actual, prob).groupBy("risk_segment").agg(
        F.count(id_col).alias("driver_count"),
        F.sum(actual).cast("long").alias("actual_claims"),
        F.count(actual).alias("__n_actual"),
        F.avg(actual).alias("claim_rate"),
        F.avg(prob).alias("avg_predicted_prob"),
        F.stddev_samp(prob).alias("std_predicted_prob"))
    everything = Window.partitionBy()  # over the tiny grouped table only
    g = g.withColumn("__overall", F.sum("actual_claims").over(everything) / F.sum("__n_actual").over(everything))
    dim = label_table(spark, labels, "risk_segment", "segment_rank")
    seg_rows = g.filter(F.col("risk_segment").isNotNull())
    overall = g.select(F.max("__overall").alias("__o"))
    return (seg_rows.join(F.broadcast(dim), "risk_segment", "right").crossJoin(F.broadcast(overall))
            .select("segment_rank", "risk_segment", F.coalesce("driver_count", F.lit(0)).alias("driver_count"),
                    F.coalesce("actual_claims", F.lit(0)).alias("actual_claims"), "claim_rate",
                    "avg_predicted_prob", "std_predicted_prob",
                    safe_div(F.col("claim_rate"), F.col("__o")).alias("lift")))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per-row error, absolute error and percentage error."""
    err = F.col(actual) - F.col(predicted)
    return df.select("*", err.alias("prediction_error"), F.abs(err).alias("absolute_error"),
                     (safe_div(F.abs(err), F.col(actual)) * 100).alias("percentage_error"))


def severity_segments(res: DataFrame, actual: str = "actual_severity", predicted: str = "predicted_severity",
                      edges=SEVERITY_EDGES, labels=SEVERITY_LABELS) -> DataFrame:
    """Q20: 11 statistics per right-closed predicted-severity segment; the
    four medians come from one distributed exact-quantile pass over the
    unpivoted (segment, metric, value) rows."""
    spark = res.sparkSession
    seg = cut(predicted, edges, labels)
    d = res.select("*", seg.alias("severity_segment")).filter(F.col("severity_segment").isNotNull())
    agg = d.groupBy("severity_segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(actual).alias("actual_mean"), F.stddev_samp(actual).alias("actual_std"),
        F.avg(predicted).alias("pred_mean"), F.stddev_samp(predicted).alias("pred_std"),
        F.avg("absolute_error").alias("mae_mean"), F.avg("percentage_error").alias("mape_mean"))
    metrics = {"actual_median": actual, "pred_median": predicted, "mae_median": "absolute_error",
               "mape_median": "percentage_error"}
    long = d.select("severity_segment", F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("v")) for k, v in metrics.items()])))
    med = exact_quantiles(long, "v", [0.5], out="__q", by=["severity_segment", "metric"]) \
        .groupBy("severity_segment").agg(*[F.max(F.when(F.col("metric") == k, F.col("__q")[0])).alias(k)
                                           for k in metrics])
    agg = agg.join(med, "severity_segment", "left")
    dim = label_table(spark, labels, "severity_segment", "segment_rank")
    return agg.join(F.broadcast(dim), "severity_segment", "right").withColumn("n", F.coalesce("n", F.lit(0)))


def group_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """Q21: count/mean/median/std/min/max of a column per category (median
    exact and distributed)."""
    d = df.filter(F.col(by).isNotNull())
    st = d.groupBy(by).agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"))
    med = exact_quantiles(d, column, [0.5], out="__q", by=[by]).select(by, F.col("__q")[0].alias("median"))
    return st.join(med, by, "left").select(by, "count", "mean", "median", "std", "min", "max")


def high_error_summary(res: DataFrame, q: float = 0.9, actual: str = "actual_severity",
                       predicted: str = "predicted_severity") -> DataFrame:
    """Q22: rows above the q-quantile of percentage error: count and means."""
    t = exact_quantile(res, "percentage_error", q, out="threshold")
    hi = res.crossJoin(F.broadcast(t)).filter(F.col("percentage_error") > F.col("threshold"))
    return hi.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("percentage_error").alias("avg_percentage_error"),
        F.avg(actual).alias("avg_actual"), F.avg(predicted).alias("avg_predicted"))
