"""The domain views of ``views.py`` as DuckDB SQL CTEs (oracle side).

Written independently of the DataFrame code, from the same mapping rules.
"""

READINGS = """
readings AS (
  SELECT
    CAST(user_id * 10 + floor((dayofmonth(ts) - 1) / 7) AS BIGINT) AS trip_key,
    CAST(user_id * 10 + floor((dayofmonth(ts) - 1) / 7) AS BIGINT) AS trip_id,
    event_id AS reading_seq,
    ts AS "timestamp",
    'device_' || CAST(user_id AS VARCHAR) AS device_id,
    CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS DOUBLE) AS gps_accuracy_meters,
    37.0 + CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) / 100 AS gps_latitude,
    -122.0 - (event_id % 100) / 100 AS gps_longitude,
    value / 2 AS speed_mph,
    (value - 50) / 15 AS accelerometer_x,
    (CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) - 50) / 15 AS accelerometer_y,
    9.81 AS accelerometer_z,
    CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS screen_on,
    CASE WHEN event_type = 'signup' THEN 'com.whatsapp' ELSE 'com.android.systemui' END AS app_foreground
  FROM events
)"""

TRIPS = """
li_agg AS (
  SELECT l_orderkey,
    sum(l_quantity) AS q_sum, sum(l_extendedprice) AS p_sum, avg(l_quantity) AS q_avg,
    max(l_quantity) AS q_max,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_r,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS n_a,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n_n,
    CAST(sum(CASE WHEN l_tax > 0.05 THEN 60 ELSE 0 END) AS BIGINT) AS phone_s,
    avg(l_discount) AS disc_avg, avg(l_tax) AS tax_avg, avg(l_linenumber) AS ln_avg
  FROM lineitem GROUP BY l_orderkey
),
trips AS (
  SELECT
    o.o_orderkey AS trip_id,
    o.o_custkey AS driver_id,
    (floor((q_sum) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS duration_minutes,
    (floor((p_sum / 5000) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS distance_miles,
    (floor((q_avg + 10) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS average_speed_mph,
    (floor((q_max * 2 + 20) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS max_speed_mph,
    n_r AS harsh_braking_events,
    n_a AS harsh_acceleration_events,
    n_n AS sharp_cornering_events,
    phone_s AS phone_usage_seconds,
    (floor((disc_avg) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS speeding_percent,
    CAST(substr(o_orderpriority, 1, 1) = '1' AS INTEGER) AS night_driving,
    CAST(substr(o_orderpriority, 1, 1) = '2' AS INTEGER) AS rush_hour,
    CASE substr(o_orderpriority, 1, 1)
      WHEN '1' THEN 'night' WHEN '2' THEN 'morning_commute' WHEN '3' THEN 'midday'
      WHEN '4' THEN 'early_morning' ELSE 'evening' END AS time_of_day,
    'zone_' || CAST(c.c_nationkey AS VARCHAR) AS start_zone,
    'zone_' || CAST(o.o_orderkey % 25 AS VARCHAR) AS end_zone,
    (floor((1 - 5 * tax_avg) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS data_quality_score,
    (floor((4 + ln_avg * 2) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS gps_accuracy_avg,
    o.o_orderdate AS trip_date,
    CAST(o.o_orderstatus = 'P' AS INTEGER) AS has_claim,
    CASE WHEN o.o_orderstatus = 'P' THEN o.o_totalprice ELSE 0.0 END AS claim_amount
  FROM orders o
  JOIN li_agg ON o.o_orderkey = li_agg.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
)"""

SCORED = """
scored AS (
  SELECT trip_id, driver_id, has_claim, claim_amount, time_of_day, trip_date,
    (floor(least(1.0, 0.05 + 0.04 * (harsh_braking_events + harsh_acceleration_events + sharp_cornering_events)
                + 0.5 * speeding_percent
                + 0.3 * has_claim * CAST(trip_id % 3 = 0 AS INTEGER)) * 10000.0 + 0.5000076293945312) / 10000.0) AS claim_probability,
    (floor((1000 + 900 * distance_miles) * 1000000.0 + 0.5000076293945312) / 1000000.0) AS claim_severity_prediction
  FROM trips
)"""

TRIP_INPUTS = """
trip_inputs AS (
  SELECT trip_id, driver_id,
    duration_minutes AS trip_duration_minutes,
    distance_miles * 1.609344 AS trip_distance_km,
    max_speed_mph * 1.609344 AS max_speed_kmh,
    average_speed_mph * 1.609344 AS avg_speed_kmh,
    CAST(harsh_braking_events AS DOUBLE) AS hard_braking_count,
    CAST(harsh_acceleration_events AS DOUBLE) AS hard_acceleration_count,
    CAST(sharp_cornering_events AS DOUBLE) AS sharp_turn_count,
    night_driving * duration_minutes AS night_driving_minutes,
    rush_hour * duration_minutes AS rush_hour_minutes,
    phone_usage_seconds / 60.0 AS phone_use_minutes,
    CAST(isodow(trip_date) IN (6, 7) AS DOUBLE) AS weekend_driving,
    duration_minutes / 60.0 AS continuous_driving_hours
  FROM trips
)"""


def with_views(*names: str) -> str:
    """WITH clause holding the requested views (dependencies included)."""
    parts = []
    order = ["readings", "trips", "scored", "trip_inputs"]
    need = set(names)
    if "scored" in need or "trip_inputs" in need:
        need.add("trips")
    text = {"readings": READINGS, "trips": TRIPS, "scored": SCORED, "trip_inputs": TRIP_INPUTS}
    for n in order:
        if n in need:
            parts.append(text[n].strip())
    return "WITH " + ",\n".join(parts) + "\n"
