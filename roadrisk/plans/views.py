"""Domain views over the driver's tables (readings, trips, scored).

The test tables carry no telematics data, so fixed mappings turn them into
the reference's data model; the same mappings exist as SQL text in
``oracle_views.py`` for the DuckDB oracle. Everything stays lazy; Catalyst
prunes the scans to the columns used here.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import r
from ..sources.tables import cut_lineage, input_version, table

KM = 1.609344


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> per-second readings; trip = user x 7-day block."""
    return readings_from_events(table(spark, sf_dir, "events",
                                      ["event_id", "ts", "user_id", "event_type", "value", "props"]))


def readings_from_events(e: DataFrame) -> DataFrame:
    """The events -> readings mapping (batch or streaming DataFrame)."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    trip = (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).cast("long")
    return e.select(
        trip.alias("trip_key"),
        trip.alias("trip_id"),
        F.col("event_id").alias("reading_seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("device_"), F.col("user_id").cast("string")).alias("device_id"),
        k.cast("double").alias("gps_accuracy_meters"),
        (F.lit(37.0) + k / 100).alias("gps_latitude"),
        (F.lit(-122.0) - (F.col("event_id") % 100) / 100).alias("gps_longitude"),
        (F.col("value") / 2).alias("speed_mph"),
        ((F.col("value") - 50) / 15).alias("accelerometer_x"),
        ((k - 50) / 15).alias("accelerometer_y"),
        F.lit(9.81).alias("accelerometer_z"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("screen_on"),
        F.when(F.col("event_type") == "signup", "com.whatsapp").otherwise("com.android.systemui")
        .alias("app_foreground"),
    )


TRIP_INPUTS = ("orders", "lineitem", "customer")


def trip_inputs_key(spark: SparkSession, sf_dir: str) -> tuple:
    """What a materialized derivation is valid for: this session and exactly these input files."""
    return spark._jsparkSession.hashCode(), input_version(spark, sf_dir, TRIP_INPUTS)


_TRIPS: dict = {}


def trips(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The trip table, kept as a reliable checkpoint in the shared folder (like
    the reference's processed-trips file that every analysis reads): queries
    that read trips several times (global statistics + rows) scan it instead of
    re-deriving it from lineitem. It is derived anew whenever an input file is
    added, replaced or removed, and in every new session; only the last
    derivation of a session is held.

    ``orders`` may be a streaming DataFrame (stream-static joins; never
    materialized)."""
    if orders is not None:
        return derive_trips(spark, sf_dir, orders)
    key = trip_inputs_key(spark, sf_dir)
    if key not in _TRIPS:
        _TRIPS.clear()
        _TRIPS[key] = cut_lineage(derive_trips(spark, sf_dir))
    return _TRIPS[key]


def derive_trips(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """orders x lineitem x customer -> one trip row per order (inner).

    lineitem is pre-aggregated per order before the join (the aggregate is
    hash-partitioned on l_orderkey, so the join with orders reuses it);
    customer joins on custkey, where AQE's skew-join split handles a hot
    customer. No side is force-broadcast: customer grows with the data.
    """
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                          "l_discount", "l_tax", "l_returnflag"])
    agg = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q_sum"),
        F.sum("l_extendedprice").alias("p_sum"),
        F.avg("l_quantity").alias("q_avg"),
        F.max("l_quantity").alias("q_max"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
        F.count_if(F.col("l_returnflag") == "N").alias("n_n"),
        F.sum(F.when(F.col("l_tax") > 0.05, 60).otherwise(0)).cast("long").alias("phone_s"),
        F.avg("l_discount").alias("disc_avg"),
        F.avg("l_tax").alias("tax_avg"),
        F.avg("l_linenumber").alias("ln_avg"),
    )
    o = orders if orders is not None else table(
        spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                  "o_orderpriority"])
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    j = o.join(agg, o.o_orderkey == agg.l_orderkey).join(c, o.o_custkey == c.c_custkey)
    p = F.substring("o_orderpriority", 1, 1)
    has_claim = (F.col("o_orderstatus") == "P").cast("int")
    return j.select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_custkey").alias("driver_id"),
        r("q_sum").alias("duration_minutes"),
        r(F.col("p_sum") / 5000).alias("distance_miles"),
        r(F.col("q_avg") + 10).alias("average_speed_mph"),
        r(F.col("q_max") * 2 + 20).alias("max_speed_mph"),
        F.col("n_r").alias("harsh_braking_events"),
        F.col("n_a").alias("harsh_acceleration_events"),
        F.col("n_n").alias("sharp_cornering_events"),
        F.col("phone_s").alias("phone_usage_seconds"),
        r("disc_avg").alias("speeding_percent"),
        (p == "1").cast("int").alias("night_driving"),
        (p == "2").cast("int").alias("rush_hour"),
        F.when(p == "1", "night").when(p == "2", "morning_commute").when(p == "3", "midday")
        .when(p == "4", "early_morning").otherwise("evening").alias("time_of_day"),
        F.concat(F.lit("zone_"), F.col("c_nationkey").cast("string")).alias("start_zone"),
        F.concat(F.lit("zone_"), (F.col("o_orderkey") % 25).cast("string")).alias("end_zone"),
        r(1 - 5 * F.col("tax_avg")).alias("data_quality_score"),
        r(4 + F.col("ln_avg") * 2).alias("gps_accuracy_avg"),
        F.col("o_orderdate").cast("timestamp").alias("trip_date"),
        has_claim.alias("has_claim"),
        F.when(has_claim == 1, F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("claim_amount"),
    )


def scored(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """trips + a fixed scoring formula standing in for the models, so that
    evaluation and scoring arithmetic is oracle-checkable (rounding makes ties)."""
    t = trips(spark, sf_dir, orders)
    total = F.col("harsh_braking_events") + F.col("harsh_acceleration_events") + F.col("sharp_cornering_events")
    p = r(F.least(F.lit(1.0), 0.05 + 0.04 * total + 0.5 * F.col("speeding_percent")
                  + 0.3 * F.col("has_claim") * ((F.col("trip_id") % 3) == 0).cast("int")), 4)
    return t.select(
        "trip_id", "driver_id", "has_claim", "claim_amount", "time_of_day", "trip_date",
        p.alias("claim_probability"),
        r(1000 + 900 * F.col("distance_miles")).alias("claim_severity_prediction"),
    )


def trip_inputs_metric(trips_df: DataFrame) -> DataFrame:
    """T11 unit bridge: imperial trip summary -> the metric input columns of the
    57-feature builder (absent in the reference; weather inputs stay absent)."""
    km = F.lit(KM)
    return trips_df.select(
        "trip_id", "driver_id",
        F.col("duration_minutes").alias("trip_duration_minutes"),
        (F.col("distance_miles") * km).alias("trip_distance_km"),
        (F.col("max_speed_mph") * km).alias("max_speed_kmh"),
        (F.col("average_speed_mph") * km).alias("avg_speed_kmh"),
        F.col("harsh_braking_events").cast("double").alias("hard_braking_count"),
        F.col("harsh_acceleration_events").cast("double").alias("hard_acceleration_count"),
        F.col("sharp_cornering_events").cast("double").alias("sharp_turn_count"),
        (F.col("night_driving") * F.col("duration_minutes")).alias("night_driving_minutes"),
        (F.col("rush_hour") * F.col("duration_minutes")).alias("rush_hour_minutes"),
        (F.col("phone_usage_seconds") / 60.0).alias("phone_use_minutes"),
        F.dayofweek("trip_date").isin(1, 7).cast("double").alias("weekend_driving"),
        (F.col("duration_minutes") / 60.0).alias("continuous_driving_hours"),
    )
