"""Trips -> driver profiles and risk scores.

Every driver aggregate is one ``groupBy(driver_id).agg`` built from a rules
dict (the reference's extension point). All functions used are algebraic,
so a driver with a third of all trips is pre-aggregated map-side; global
statistics (min/max scaling, quantile thresholds) are 1-row aggregates joined
back with a broadcast, never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_lower, cut, cut_rank, flag, quote, round_half_up_sql, safe_div

AGG_FUNCS = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "median": lambda c: F.median(c),
}

# Fixed values that must equal the reference.
BASIC_RULES = {
    "trip_id": ["count"],
    "duration_minutes": ["sum", "mean", "std"],
    "distance_miles": ["sum", "mean", "std"],
    "average_speed_mph": ["mean", "std"],
    "max_speed_mph": ["mean", "max"],
    "harsh_braking_events": ["sum", "mean"],
    "harsh_acceleration_events": ["sum", "mean"],
    "sharp_cornering_events": ["sum", "mean"],
    "phone_usage_seconds": ["sum", "mean"],
    "speeding_percent": ["mean", "max"],
    "night_driving": ["mean"],
    "rush_hour": ["mean"],
}

# Fixed values that must equal the reference.
FULL_RULES = {
    "trip_id": ["count"],
    "duration_minutes": ["mean", "std", "sum"],
    "distance_miles": ["mean", "std", "sum"],
    "average_speed_mph": ["mean", "std"],
    "max_speed_mph": ["mean", "max"],
    "harsh_braking_events": ["mean", "sum"],
    "harsh_acceleration_events": ["mean", "sum"],
    "sharp_cornering_events": ["mean", "sum"],
    "total_harsh_events": ["mean", "sum"],
    "harsh_events_per_mile": ["mean"],
    "harsh_events_per_minute": ["mean"],
    "phone_usage_seconds": ["mean", "sum"],
    "phone_usage_percent": ["mean"],
    "phone_usage_flag": ["mean"],
    "excessive_phone_use": ["mean"],
    "speeding_percent": ["mean"],
    "speed_variance": ["mean"],
    "speed_ratio": ["mean"],
    "high_speed_flag": ["mean"],
    "excessive_speed_flag": ["mean"],
    "night_driving": ["mean"],
    "rush_hour": ["mean"],
    "high_risk_time": ["mean"],
    "long_trip_flag": ["mean"],
    "short_trip_flag": ["mean"],
    "extended_duration_flag": ["mean"],
    "trip_efficiency": ["mean"],
    "data_quality_score": ["mean"],
    "gps_accuracy_avg": ["mean"],
    "low_quality_data": ["mean"],
    "poor_gps_accuracy": ["mean"],
}
FULL_RENAMES = {
    "trip_id_count": "total_trips",
    "duration_minutes_sum": "total_driving_time_minutes",
    "distance_miles_sum": "total_distance_miles",
}

# Fixed values that must equal the reference.
EDA_RULES = {
    "trip_id": ["count"],
    "duration_minutes": ["sum", "mean"],
    "distance_miles": ["sum", "mean"],
    "harsh_braking_events": ["sum", "mean"],
    "harsh_acceleration_events": ["sum", "mean"],
    "sharp_cornering_events": ["sum", "mean"],
    "phone_usage_seconds": ["sum", "mean"],
    "speeding_percent": ["mean"],
    "night_driving": ["mean"],
    "rush_hour": ["mean"],
}

# Composite-score cut points and labels (right-closed bins).
# Fixed values that must equal the reference.
COMPOSITE_EDGES = (float("-inf"), 10.0, 25.0, 50.0, float("inf"))
COMPOSITE_LABELS = ("Low", "Medium", "High", "Very High")


AGG_SQL = {"count": "count", "sum": "sum", "mean": "avg", "std": "stddev_samp", "max": "max", "min": "min",
           "median": "median"}


def rules_aggs(rules: dict, renames: dict | None = None, digits: int | None = None) -> list[Column]:
    """`{col: [fn, ...]}` -> aggregate columns named `{col}_{fn}` (pandas
    flattening). Built as SQL expression text: one JVM call per column."""
    renames = renames or {}
    out = []
    for c, fns in rules.items():
        for fn in fns:
            name = f"{c}_{fn}"
            e = f"{AGG_SQL[fn]}({quote(c)})"
            if fn == "count":
                e = f"CAST({e} AS BIGINT)"
            elif digits is not None:
                e = round_half_up_sql(e, digits)
            out.append(F.expr(e).alias(renames.get(name, name)))
    return out


def aggregate_by(df: DataFrame, key: str, rules: dict, renames: dict | None = None,
                 digits: int | None = None, extra: list[Column] | None = None) -> DataFrame:
    """Rules-dict group-by; null keys are dropped like pandas groupby."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*rules_aggs(rules, renames, digits), *(extra or []))


def driver_features_basic(trips: DataFrame, key: str = "driver_id") -> DataFrame:
    """Basic driver aggregate + ratios + high-risk time shares.

    G6 is folded into the same aggregate (share = trips in category / trips
    with a category) instead of a pivot and left join; both columns are
    always emitted."""
    tod = F.col("time_of_day")
    shares = [
        safe_div(F.sum(flag(tod == cat)), F.count(tod)).alias(f"{cat}_driving_pct")
        for cat in ("night", "early_morning")
    ]
    d = aggregate_by(trips, key, BASIC_RULES, {"trip_id_count": "total_trips"}, extra=shares)
    events = F.col("harsh_braking_events_sum") + F.col("harsh_acceleration_events_sum") + F.col("sharp_cornering_events_sum")
    return d.select(
        key, "total_trips", *[c for c in d.columns if c not in (key, "total_trips") and not c.endswith("_driving_pct")],
        (events / clip_lower("distance_miles_sum", 1.0)).alias("events_per_mile"),
        (F.col("phone_usage_seconds_sum") / clip_lower(F.col("duration_minutes_sum") / 60, 0.1)).alias("phone_usage_per_hour"),
        (1 / (1 + F.col("average_speed_mph_std"))).alias("speed_consistency"),
        "night_driving_pct", "early_morning_driving_pct",
    )


def driver_time_share_pivot(trips: DataFrame, key: str = "driver_id",
                            categories=("early_morning", "morning_commute", "midday", "evening_commute",
                                        "evening", "night")) -> DataFrame:
    """Trips per (driver, time_of_day) pivoted to fixed columns, row-normalised."""
    p = (trips.filter(F.col(key).isNotNull() & F.col("time_of_day").isNotNull())
         .groupBy(key).pivot("time_of_day", list(categories)).count())
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in categories), F.lit(0))
    return p.select(key, *[(F.coalesce(F.col(c), F.lit(0)) / total).alias(f"{c}_share") for c in categories])


def driver_features_full(enriched: DataFrame, key: str = "driver_id") -> DataFrame:
    """42 aggregates rounded to 4 dp (inputs from `enrich_trips`)."""
    return aggregate_by(enriched, key, FULL_RULES, FULL_RENAMES, digits=4)


def driver_frequency_experience(df: DataFrame) -> DataFrame:
    """Frequency and experience indicators on `driver_features_full`."""
    return df.select(
        "*",
        (F.col("total_trips") / 30).alias("avg_trips_per_day"),
        safe_div("total_distance_miles", "total_trips").alias("avg_miles_per_trip"),
        safe_div("total_driving_time_minutes", "total_trips").alias("avg_duration_per_trip"),
        flag(F.col("total_distance_miles") > 1000).alias("high_mileage_driver"),
        flag(F.col("total_trips") > 50).alias("frequent_driver"),
        flag(F.col("duration_minutes_std") < 30).alias("consistent_driver"),
    )


def driver_risk_scores(df: DataFrame) -> DataFrame:
    """G10 + Q15: intensity, speed, distraction, timing, composite scores and
    the right-closed composite category."""
    d = df.select(
        "*",
        (F.col("harsh_braking_events_mean") + F.col("harsh_acceleration_events_mean")
         + F.col("sharp_cornering_events_mean")).alias("harsh_driving_intensity"),
        (F.col("speeding_percent_mean") * 0.4 + F.col("high_speed_flag_mean") * 30
         + F.col("excessive_speed_flag_mean") * 50).alias("speed_risk_score"),
        (F.col("phone_usage_percent_mean") * 2 + F.col("excessive_phone_use_mean") * 20).alias("distraction_risk_score"),
        (F.col("night_driving_mean") * 15 + F.col("rush_hour_mean") * 10).alias("timing_risk_score"),
    )
    d = d.withColumn(
        "composite_risk_score",
        F.col("harsh_driving_intensity") * 10 + F.col("speed_risk_score") * 0.3
        + F.col("distraction_risk_score") * 0.5 + F.col("timing_risk_score") * 0.2,
    )
    return d.withColumn("risk_category", cut("composite_risk_score", COMPOSITE_EDGES, COMPOSITE_LABELS)) \
            .withColumn("risk_category_rank", cut_rank("composite_risk_score", COMPOSITE_EDGES))


def driver_profiles(enriched: DataFrame, key: str = "driver_id") -> DataFrame:
    """55-column driver table = G7 + G9 + G10."""
    return driver_risk_scores(driver_frequency_experience(driver_features_full(enriched, key))).drop(
        "risk_category_rank")


def eda_driver_stats(trips: DataFrame, key: str = "driver_id") -> DataFrame:
    """17 EDA aggregates rounded to 2 dp."""
    return aggregate_by(trips, key, EDA_RULES, {"trip_id_count": "total_trips"}, digits=2)


def driver_hourly_rates(trips: DataFrame, key: str = "driver_id") -> DataFrame:
    """Per-hour event and phone rates per driver."""
    d = trips.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("harsh_braking_events").alias("harsh_braking_events"),
        F.sum("harsh_acceleration_events").alias("harsh_acceleration_events"),
        F.sum("sharp_cornering_events").alias("sharp_cornering_events"),
        F.sum("phone_usage_seconds").alias("phone_usage_seconds"),
        F.avg("speeding_percent").alias("speeding_percent"),
        F.avg("night_driving").alias("night_driving"),
        F.sum("duration_minutes").alias("duration_minutes"),
    )
    hours = F.col("duration_minutes") / 60
    events = F.col("harsh_braking_events") + F.col("harsh_acceleration_events") + F.col("sharp_cornering_events")
    return d.select("*", safe_div(events, hours).alias("harsh_events_per_hour"),
                    safe_div("phone_usage_seconds", hours).alias("phone_usage_per_hour"))


# Fixed values that must equal the reference.
MINMAX_FACTORS = ("harsh_events_per_hour", "phone_usage_per_hour", "speeding_percent", "night_driving")


def minmax_risk_score(df: DataFrame, factors=MINMAX_FACTORS, out: str = "risk_score") -> DataFrame:
    """Each factor min-max scaled to 0-100 over all rows (a constant
    factor scales to 0), then averaged. Global min/max are one 1-row
    aggregate joined back with a broadcast (J5)."""
    stats = df.agg(*[F.min(f).alias(f"__mn_{f}") for f in factors], *[F.max(f).alias(f"__mx_{f}") for f in factors])
    d = df.crossJoin(F.broadcast(stats))
    scaled = []
    for f in factors:
        rng = F.col(f"__mx_{f}") - F.col(f"__mn_{f}")
        scaled.append(F.when(rng == 0, F.lit(0.0)).otherwise((F.col(f) - F.col(f"__mn_{f}")) / rng * 100))
    score = sum(scaled[1:], scaled[0]) / len(factors)
    return d.select(*df.columns, score.alias(out))


def poc_driver_features(drivers: DataFrame) -> DataFrame:
    """POC ratios on a basic driver aggregate (no clipping; x/0 -> NULL)."""
    events = F.col("harsh_braking_events_sum") + F.col("harsh_acceleration_events_sum") + F.col("sharp_cornering_events_sum")
    return drivers.select(
        "*",
        safe_div(events, "distance_miles_sum").alias("poc_events_per_mile"),
        safe_div("phone_usage_seconds_sum", F.col("duration_minutes_sum") / 60).alias("poc_phone_usage_per_hour"),
        (F.col("night_driving_mean") * F.col("distance_miles_sum")).alias("night_driving_miles"),
        (F.col("speeding_percent_mean") * F.col("max_speed_mph_mean")).alias("speeding_severity"),
    )


def driver_claims(trips: DataFrame, key: str = "driver_id") -> DataFrame:
    """Per-driver claim outcome (the D12 had_claim_* / claim_amount_* columns)."""
    return trips.groupBy(key).agg(
        F.sum("has_claim").cast("long").alias("had_claim_sum"),
        F.avg("has_claim").alias("had_claim_mean"),
        F.sum("claim_amount").alias("claim_amount_sum"),
        F.avg("claim_amount").alias("claim_amount_mean"),
    )


def driver_prior_risk(profiles: DataFrame) -> DataFrame:
    """Deterministic part of the notebook targets — prior claim
    probability and expected severity, each term scaled by its column max
    over all drivers (1-row max aggregate, broadcast)."""
    cols = ["composite_risk_score", "harsh_driving_intensity", "speed_risk_score", "distraction_risk_score",
            "total_distance_miles"]
    mx = profiles.agg(*[F.max(c).alias(f"__max_{c}") for c in cols])
    d = profiles.crossJoin(F.broadcast(mx))

    def rel(c):
        return safe_div(F.col(c), F.col(f"__max_{c}"))

    p = (0.05 + 0.15 * rel("composite_risk_score") + 0.10 * rel("harsh_driving_intensity")
         + 0.08 * rel("speed_risk_score") + 0.05 * rel("distraction_risk_score"))
    sev = 2000 * (1.0 + 0.8 * rel("composite_risk_score") + 0.6 * rel("speed_risk_score")
                  + 0.4 * rel("harsh_driving_intensity") + 0.3 * rel("total_distance_miles")
                  + 0.2 * F.col("night_driving_mean") + 0.1 * F.col("excessive_speed_flag_mean"))
    return d.select(
        "driver_id",
        F.least(F.greatest(p, F.lit(0.0)), F.lit(0.4)).alias("prior_claim_probability"),
        sev.alias("expected_claim_severity"),
    )
