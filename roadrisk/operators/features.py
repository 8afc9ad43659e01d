"""T1-T13 trip features, F8-F10 audits.

The 57 model features are two chained projections (T2-T6, then T7 on their
outputs): narrow, shuffle-free, inside one whole-stage-codegen span.
Absent input columns count as 0 (the reference's intent); rates fall back to
a unit denominator when distance/duration are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalar import clip_lower, flag, safe_div

# Fixed values that must equal the reference.
FEATURE_NAMES = [
    # basic
    "trip_duration_minutes", "trip_distance_km", "avg_trip_speed", "log_trip_duration", "log_trip_distance",
    "trip_efficiency",
    # speed
    "max_speed_kmh", "avg_speed_kmh", "speed_variance", "high_speed_indicator", "very_high_speed_indicator",
    "speed_consistency", "speeding_severity",
    # behaviour
    "hard_braking_count", "hard_acceleration_count", "sharp_turn_count", "total_aggressive_events",
    "hard_braking_rate", "hard_acceleration_rate", "aggressive_events_rate", "hard_braking_per_hour",
    "hard_acceleration_per_hour", "has_hard_braking", "has_hard_acceleration", "has_aggressive_driving",
    "driving_smoothness",
    # time
    "night_driving_minutes", "rush_hour_minutes", "night_driving_ratio", "rush_hour_ratio", "has_night_driving",
    "majority_night_driving", "has_rush_hour_driving", "weekend_driving", "time_risk_score",
    # risk
    "phone_use_minutes", "phone_use_ratio", "has_phone_use", "excessive_phone_use", "continuous_driving_hours",
    "fatigue_risk", "high_fatigue_risk", "adverse_weather", "rain_driving", "snow_driving", "fog_driving",
    "weather_risk_score", "high_traffic_ratio", "traffic_risk", "total_risk_factors",
    # interaction
    "speed_aggression_interaction", "night_speed_risk", "long_trip_aggression", "distracted_speeding",
    "fatigue_night_risk", "weather_aggression_risk", "composite_risk_score",
]
assert len(FEATURE_NAMES) == 57

# Domain importance hints (fixed values); every other feature defaults to 0.3.
IMPORTANCE_HINTS = {
    "total_aggressive_events": 0.9, "aggressive_events_rate": 0.9, "max_speed_kmh": 0.8,
    "speeding_severity": 0.8, "composite_risk_score": 0.85, "phone_use_ratio": 0.75,
    "night_driving_ratio": 0.6, "hard_braking_rate": 0.65, "hard_acceleration_rate": 0.65,
    "speed_variance": 0.6, "weather_risk_score": 0.55, "fatigue_risk": 0.5,
    "trip_distance_km": 0.4, "trip_duration_minutes": 0.4, "weekend_driving": 0.3, "rush_hour_ratio": 0.35,
    "speed_aggression_interaction": 0.7, "night_speed_risk": 0.65, "distracted_speeding": 0.7,
    "weather_aggression_risk": 0.6,
}
DEFAULT_IMPORTANCE = 0.3


def enrich_trips(trips: DataFrame) -> DataFrame:
    """Imperial trip enrichment (17 derived columns, eps = 1e-6)."""
    eps = 1e-6
    mx, av = F.col("max_speed_mph"), F.col("average_speed_mph")
    dist, dur = F.col("distance_miles"), F.col("duration_minutes")
    total = F.col("harsh_braking_events") + F.col("harsh_acceleration_events") + F.col("sharp_cornering_events")
    d = trips.select(
        "*",
        (mx - av).alias("speed_variance"),
        (mx / (av + eps)).alias("speed_ratio"),
        flag(mx > 80).alias("high_speed_flag"),
        flag(mx > 100).alias("excessive_speed_flag"),
        total.alias("total_harsh_events"),
        (total / (dist + eps)).alias("harsh_events_per_mile"),
        (total / (dur + eps)).alias("harsh_events_per_minute"),
        (safe_div(F.col("phone_usage_seconds"), dur * 60) * 100).alias("phone_usage_percent"),
        flag(F.col("phone_usage_seconds") > 0).alias("phone_usage_flag"),
        (dist / (dur + eps)).alias("trip_efficiency"),
        flag(dist > 50).alias("long_trip_flag"),
        flag(dist < 5).alias("short_trip_flag"),
        flag(dur > 120).alias("extended_duration_flag"),
        flag((F.col("night_driving") == 1) | (F.col("rush_hour") == 1)).alias("high_risk_time"),
    )
    extra = []
    if "data_quality_score" in trips.columns:
        extra.append(flag(F.col("data_quality_score") < 0.8).alias("low_quality_data"))
    if "gps_accuracy_avg" in trips.columns:
        extra.append(flag(F.col("gps_accuracy_avg") > 10).alias("poor_gps_accuracy"))
    return d.select("*", flag(F.col("phone_usage_percent") > 10).alias("excessive_phone_use"), *extra)


def _in(df: DataFrame, name: str, absent: float = 0.0) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(absent)


def create_features(df: DataFrame, keep: tuple[str, ...] = ("trip_id", "driver_id")) -> DataFrame:
    """The 57 features, in the reference's order, as doubles; id
    columns listed in `keep` travel alongside (never positional)."""
    cols = df.columns
    dur, dist = _in(df, "trip_duration_minutes"), _in(df, "trip_distance_km")
    mx, av = _in(df, "max_speed_kmh"), _in(df, "avg_speed_kmh")
    hb, ha, st = _in(df, "hard_braking_count"), _in(df, "hard_acceleration_count"), _in(df, "sharp_turn_count")
    rate_dist = clip_lower(_in(df, "trip_distance_km", 1.0) if "trip_distance_km" in cols else F.lit(1.0), 0.1)
    dur_or_one = _in(df, "trip_duration_minutes", 1.0) if "trip_duration_minutes" in cols else F.lit(1.0)
    hours = clip_lower(dur_or_one / 60, 0.01)
    total_dur = clip_lower(dur_or_one, 1.0)
    night, rush = _in(df, "night_driving_minutes"), _in(df, "rush_hour_minutes")
    phone, cont = _in(df, "phone_use_minutes"), _in(df, "continuous_driving_hours")
    aw, rain, snow, fog = (_in(df, c) for c in ("adverse_weather", "rain_driving", "snow_driving", "fog_driving"))
    traffic, weekend = _in(df, "high_traffic_ratio"), _in(df, "weekend_driving")
    total = hb + ha + st
    night_ratio, rush_ratio = night / total_dur, rush / total_dur
    phone_ratio = phone / total_dur
    weather = aw * 0.2 + rain * 0.3 + snow * 0.4 + fog * 0.3
    has_phone, fatigue, traffic_risk = flag(phone > 0), flag(cont > 2), flag(traffic > 0.5)
    first = [
        dur.alias("trip_duration_minutes"),
        dist.alias("trip_distance_km"),
        F.when(dur > 0, dist / (dur / 60)).otherwise(0.0).alias("avg_trip_speed"),
        F.log1p(dur).alias("log_trip_duration"),
        F.log1p(dist).alias("log_trip_distance"),
        F.when(dist > 0, dur / dist).otherwise(0.0).alias("trip_efficiency"),
        mx.alias("max_speed_kmh"),
        av.alias("avg_speed_kmh"),
        F.when(av > 0, (mx - av) / av).otherwise(0.0).alias("speed_variance"),
        flag(mx > 120).alias("high_speed_indicator"),
        flag(mx > 140).alias("very_high_speed_indicator"),
        F.when(mx > 0, av / mx).otherwise(0.0).alias("speed_consistency"),
        F.greatest(F.lit(0.0), (mx - 100) / 100).alias("speeding_severity"),
        hb.alias("hard_braking_count"),
        ha.alias("hard_acceleration_count"),
        st.alias("sharp_turn_count"),
        total.alias("total_aggressive_events"),
        (hb / rate_dist).alias("hard_braking_rate"),
        (ha / rate_dist).alias("hard_acceleration_rate"),
        (total / rate_dist).alias("aggressive_events_rate"),
        (hb / hours).alias("hard_braking_per_hour"),
        (ha / hours).alias("hard_acceleration_per_hour"),
        flag(hb > 0).alias("has_hard_braking"),
        flag(ha > 0).alias("has_hard_acceleration"),
        flag(total > 0).alias("has_aggressive_driving"),
        (1 / (1 + total)).alias("driving_smoothness"),
        night.alias("night_driving_minutes"),
        rush.alias("rush_hour_minutes"),
        night_ratio.alias("night_driving_ratio"),
        rush_ratio.alias("rush_hour_ratio"),
        flag(night > 0).alias("has_night_driving"),
        flag(night_ratio > 0.5).alias("majority_night_driving"),
        flag(rush > 0).alias("has_rush_hour_driving"),
        weekend.alias("weekend_driving"),
        (night_ratio * 0.3 + rush_ratio * 0.2 + weekend * 0.1).alias("time_risk_score"),
        phone.alias("phone_use_minutes"),
        phone_ratio.alias("phone_use_ratio"),
        has_phone.alias("has_phone_use"),
        flag(phone_ratio > 0.1).alias("excessive_phone_use"),
        cont.alias("continuous_driving_hours"),
        fatigue.alias("fatigue_risk"),
        flag(cont > 4).alias("high_fatigue_risk"),
        aw.alias("adverse_weather"),
        rain.alias("rain_driving"),
        snow.alias("snow_driving"),
        fog.alias("fog_driving"),
        weather.alias("weather_risk_score"),
        traffic.alias("high_traffic_ratio"),
        traffic_risk.alias("traffic_risk"),
        (has_phone + fatigue + aw + traffic_risk).alias("total_risk_factors"),
    ]
    ids = [c for c in keep if c in cols]
    base = df.select(*ids, *first)
    c = F.col
    inter = [
        (c("max_speed_kmh") * c("total_aggressive_events") / 100).alias("speed_aggression_interaction"),
        (c("night_driving_ratio") * c("max_speed_kmh") / 100).alias("night_speed_risk"),
        (c("log_trip_distance") * c("aggressive_events_rate")).alias("long_trip_aggression"),
        (c("phone_use_ratio") * c("speeding_severity")).alias("distracted_speeding"),
        (c("continuous_driving_hours") * c("night_driving_ratio")).alias("fatigue_night_risk"),
        (c("weather_risk_score") * c("total_aggressive_events")).alias("weather_aggression_risk"),
        F.least(
            c("speed_variance") * 0.15 + c("aggressive_events_rate") * 0.25 + c("time_risk_score") * 0.20
            + c("phone_use_ratio") * 0.20 + c("weather_risk_score") * 0.20,
            F.lit(1.0),
        ).alias("composite_risk_score"),
    ]
    out = base.select("*", *inter)
    return out.select(*ids, *[F.col(n).cast("double").alias(n) for n in FEATURE_NAMES])


def long_values(df: DataFrame, columns: list[str], name: str = "feature", value: str = "v") -> DataFrame:
    """Unpivot columns to (name, value) rows (doubles), nulls kept."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(F.inline(pairs))


def _long_stats(df: DataFrame, columns: list[str], stats: dict) -> DataFrame:
    """Per-column statistics as one small group-by over the unpivoted values.

    One aggregate per statistic keyed by column name (57 groups, partial
    aggregation map-side) instead of columns x statistics aggregates in one
    row: the wide form exceeds the generated-method limit and runs
    interpreted, the long form stays in whole-stage codegen."""
    long = long_values(df, columns)
    return long.groupBy("feature").agg(*[fn(F.col("v")).alias(s) for s, fn in stats.items()])


def feature_stats(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, std, min, max, missing ratio per feature (long form)."""
    columns = columns or [c for c in FEATURE_NAMES if c in features.columns]
    return _long_stats(features, columns, {
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "missing_ratio": lambda c: F.avg(c.isNull().cast("double")),
    })


def feature_validation(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """per feature missing ratio, constant, infinite, negative-count and
    outside-[0,1] checks; `valid` is false for issues (inf, negative count)."""
    columns = columns or [c for c in FEATURE_NAMES if c in features.columns]
    st = _long_stats(features, columns, {
        "missing_ratio": lambda c: F.avg(c.isNull().cast("double")),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "n_inf": lambda c: F.count_if(F.abs(c.cast("double")) == float("inf")),
    })
    f = F.col("feature")
    countlike = f.contains("count") | f.contains("minutes") | f.contains("hours")
    unitlike = f.contains("ratio") | f.contains("indicator")
    d = st.select(
        "feature", "missing_ratio", "min", "max",
        flag(F.col("missing_ratio") > 0.1).alias("high_missing"),
        flag(F.col("min").eqNullSafe(F.col("max"))).alias("is_constant"),
        flag(F.col("n_inf") > 0).alias("has_infinite"),
        flag(countlike & (F.col("min") < 0)).alias("negative_values"),
        flag(unitlike & ((F.col("min") < 0) | (F.col("max") > 1))).alias("outside_unit_range"),
    )
    return d.withColumn("valid", flag((F.col("has_infinite") == 0) & (F.col("negative_values") == 0)))


def importance_hints(spark, feature_names: list[str] | None = None) -> DataFrame:
    """Domain importance hint per feature (small fixed lookup, default 0.3)."""
    names = feature_names or FEATURE_NAMES
    hints = spark.createDataFrame(list(IMPORTANCE_HINTS.items()), "feature string, hint double")
    feats = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, position int")
    return feats.join(F.broadcast(hints), "feature", "left").select(
        "feature", "position", F.coalesce("hint", F.lit(DEFAULT_IMPORTANCE)).alias("importance_hint"))


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """F8: null count per column, one pass, long form."""
    columns = columns or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns
    ])))


def median_impute(df: DataFrame, columns: list[str], approx_accuracy: int | None = None) -> DataFrame:
    """+-inf -> NULL, then NULL -> column median (exact, pandas linear
    interpolation; pass `approx_accuracy` for percentile_approx at scale).
    The medians of all columns are one 1-row aggregate joined back with a broadcast."""
    def clean(c):
        x = F.col(c).cast("double")
        return F.when(F.abs(x) == float("inf"), F.lit(None).cast("double")).otherwise(x)

    cleaned = df.select(*[c for c in df.columns if c not in columns], *[clean(c).alias(c) for c in columns])
    if approx_accuracy:
        m = cleaned.agg(*[F.percentile_approx(c, 0.5, approx_accuracy).alias(f"__med_{c}") for c in columns])
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).alias("__x")) for c in columns])
        q = exact_quantiles(cleaned.select(F.inline(pairs)), "__x", [0.5], out="__q", by=["__column"])
        m = q.agg(*[F.max(F.when(F.col("__column") == c, F.col("__q")[0])).alias(f"__med_{c}") for c in columns])
    d = cleaned.crossJoin(F.broadcast(m))
    return d.select(*[F.coalesce(F.col(c), F.col(f"__med_{c}")).alias(c) if c in columns else F.col(c)
                      for c in df.columns])


def eda_events_per_mile(trips: DataFrame) -> DataFrame:
    """Total harsh events per mile with a 0.1-mile floor."""
    total = F.col("harsh_braking_events") + F.col("harsh_acceleration_events") + F.col("sharp_cornering_events")
    return trips.select("*", total.alias("total_harsh_events"),
                        (total / clip_lower("distance_miles", 0.1)).alias("events_per_mile"))


def calendar_columns(trips: DataFrame, date_col: str = "trip_date") -> DataFrame:
    """Weekday name and ISO week from the real trip date."""
    return trips.select("*", F.date_format(date_col, "EEEE").alias("day_of_week"),
                        F.weekofyear(date_col).alias("week_number"))
