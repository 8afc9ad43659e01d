"""Raw sensor JSON -> normalised readings.

Every file (or, with ``json_lines=True``, every line) is one document in one
of five shapes: list of trip docs, list of readings, one trip doc, a
``{readings: [...]}`` doc, or one flat reading. The text is parsed with one
document schema (as an array or as an object), flat readings once more as maps;
per document we build an array of trips, each an array of readings, then
``posexplode`` twice so the reading order inside a trip (``reading_seq``) is exact.

Readings are maps, so a key that is there with a null differs from one that is
absent. Column-absence defaults (N1) are decided per trip by the union of its
readings' keys, i.e. on the document row itself: no window, no shuffle. Every
``trip_metadata`` key stands for a column that no reading has; all of them are
kept in the column ``metadata`` as well.
A multi-line JSON file can only be parsed by one task; for large landings use
JSON lines (one document per line) or Parquet, which split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import content_ids
from .. import config as C
from ..schemas import NUMERIC_READING_FIELDS, OPTIONAL_NUMERIC_FIELDS, RAW_DOC, RAW_READING, READING_FIELDS, TRIP_METADATA


CORRUPT = "_corrupt_record"


def _parsed(text: DataFrame) -> DataFrame:
    """``text`` plus is_list, and obj (the document as an object or null). A document
    that isn't JSON, or neither a list nor an object, is null: from_json alone
    would make a struct of nulls of it. Each step is a column that the next refers
    to: inside one expression the text would be parsed at every mention."""
    bare = F.regexp_replace("value", r"^[\s\uFEFF]+", "")
    checked = F.from_json("value", T.StructType([*RAW_DOC.fields, T.StructField(CORRUPT, T.StringType())]),
                          {"columnNameOfCorruptRecord": CORRUPT})
    d = text.withColumn("__head", F.substring(bare, 1, 1))
    d = d.select("*", (F.col("__head") == "[").alias("is_list"), F.when(F.col("__head") == "{", checked).alias("__checked"))
    c = F.col("__checked")
    obj = F.when(c.isNotNull() & c[CORRUPT].isNull(), F.struct(*[c[f.name].alias(f.name) for f in RAW_DOC.fields]))
    return d.withColumn("obj", obj).drop("__head", "__checked")


def rejected_documents(text: DataFrame) -> DataFrame:
    """(file_path, doc_no, value) of the documents that cannot be parsed and give no trips."""
    arr = F.from_json("value", T.ArrayType(RAW_DOC))
    good = F.when(F.col("is_list"), arr.isNotNull()).otherwise(F.col("obj").isNotNull())
    return _parsed(text).filter(F.coalesce(~good, F.lit(True))).select(*text.columns)


def parse_documents(text: DataFrame) -> DataFrame:
    """(file_path, doc_no, value) -> one row per trip: trip_key, readings, meta."""
    # from_json with an array schema also wraps a lone object, so the top-level
    # kind is decided from the first non-blank character.
    arr = F.when(F.col("is_list"), F.from_json("value", T.ArrayType(RAW_DOC)))
    d = _parsed(text).select("file_path", "doc_no", "value", arr.alias("arr"), "obj")
    d = d.withColumn("flat", F.when(F.col("obj").isNotNull() & F.col("obj.sensor_readings").isNull() & F.col("obj.readings").isNull(),
                                    F.from_json("value", RAW_READING)))
    d = d.withColumn("flats", F.when((F.size("arr") > 0) & F.col("arr")[0]["sensor_readings"].isNull(),
                                     F.from_json("value", T.ArrayType(RAW_READING))))
    trip_t = lambda rd, meta: F.struct(rd.alias("readings"), meta.alias("meta"))
    no_meta = F.lit(None).cast(TRIP_METADATA)
    o = F.col("obj")
    # a document that names sensor_readings or readings without having any gives no trips
    trips = (
        F.when((F.size("arr") > 0) & (F.col("flats").isNull() | F.map_contains_key(F.col("flats")[0], "sensor_readings")),
               F.transform("arr", lambda e: trip_t(e["sensor_readings"], e["trip_metadata"])))
        .when(F.size("arr") > 0, F.array(trip_t(F.col("flats"), no_meta)))
        .when(o["sensor_readings"].isNotNull(), F.array(trip_t(o["sensor_readings"], o["trip_metadata"])))
        .when(F.map_contains_key("flat", "sensor_readings"), F.lit(None))
        .when(o["readings"].isNotNull(), F.array(trip_t(o["readings"], no_meta)))
        .when(F.map_contains_key("flat", "readings"), F.lit(None))
        .when(o.isNotNull(), F.array(trip_t(F.array("flat"), no_meta)))
    )
    d = d.select("file_path", "doc_no", F.posexplode(trips).alias("trip_idx", "trip"))
    return d.select(
        F.concat_ws("#", "file_path", F.col("doc_no").cast("string"), F.col("trip_idx").cast("string")).alias("trip_key"),
        "file_path",
        F.col("trip.readings").alias("readings"),
        F.col("trip.meta").alias("meta"),
    ).filter((F.size("readings") > 0) & (F.exists("readings", lambda r: F.size(r) > 0) | (F.coalesce(F.size("meta"), F.lit(0)) > 0)))


def normalize_readings(trips: DataFrame, convert_speed_ms: bool = False) -> DataFrame:
    """N1-N5 on one row per trip, then explode to one row per reading."""
    no_names = F.array().cast("array<string>")
    keys = F.array_distinct(F.flatten(F.transform("readings", lambda r: F.coalesce(F.map_keys(r), no_names))))
    t = trips.select("trip_key", "file_path", "readings", "meta", keys.alias("__keys"))
    flags = []
    for f in READING_FIELDS:
        flags += [F.array_contains("__keys", f).alias(f"__has_{f}"),
                  F.coalesce(F.map_contains_key("meta", f), F.lit(False)).alias(f"__meta_{f}")]
    t = t.select("*", *flags)
    # An unparsable timestamp drops the whole trip; N4: without any, times are made up.
    good = lambda x: x.isNull() | F.try_to_timestamp(x).isNotNull()
    own, of_trip = F.col("__has_timestamp"), F.col("meta")["timestamp"]
    t = t.filter(F.when(own, F.forall("readings", lambda r: good(r["timestamp"])))
                 .otherwise(F.coalesce(good(of_trip), F.lit(True))))
    t = t.withColumn("__timed", F.when(own, F.exists("readings", lambda r: r["timestamp"].isNotNull()))
                     .otherwise(of_trip.isNotNull()))
    x = t.drop("__keys").select("*", F.posexplode("readings").alias("reading_seq", "r")).drop("readings")

    def has(f):
        return F.col(f"__has_{f}") | F.col(f"__meta_{f}")

    def raw(f):  # S4: trip_metadata fills columns that no reading carries
        return F.when(F.col(f"__has_{f}"), F.col("r")[f]).when(F.col(f"__meta_{f}"), F.col("meta")[f])

    def num(f: str, default: float) -> Column:
        # N1 then N2: absent column -> default; present but null/garbage/"NaN" -> 0.
        x = F.nanvl(raw(f).try_cast("double"), F.lit(0.0))
        return F.when(has(f), F.coalesce(x, F.lit(0.0))).otherwise(F.lit(default))

    defaults = dict(C.READING_DEFAULTS)
    start = F.to_timestamp(F.lit(C.SYNTHETIC_START))
    stem = F.regexp_extract(F.col("file_path"), r"([^/]*?)(\.[^./]*)?$", 1)
    out = [
        "trip_key",
        F.col("reading_seq").cast("long").alias("reading_seq"),
        F.when(F.col("__timed"), F.try_to_timestamp(raw("timestamp")))
        .otherwise(start + F.make_interval(secs=F.col("reading_seq").cast("decimal(18,6)")))
        .alias("timestamp"),
        F.when(has("trip_id"), raw("trip_id")).otherwise(stem).alias("trip_id"),
        F.when(has("device_id"), raw("device_id")).otherwise(F.lit("unknown_device")).alias("device_id"),
    ]
    for f in NUMERIC_READING_FIELDS:
        out.append(num(f, defaults[f]).alias(f))
    screen = raw("screen_on")
    out.append(
        F.when(has("screen_on"),
               F.when(F.lower(screen).isin("true", "1", "1.0"), 1).otherwise(0))
        .otherwise(F.lit(defaults["screen_on"])).alias("screen_on")
    )
    out.append(F.when(has("app_foreground"), raw("app_foreground"))
               .otherwise(F.lit(defaults["app_foreground"])).alias("app_foreground"))
    for f in OPTIONAL_NUMERIC_FIELDS:
        out.append(raw(f).try_cast("double").alias(f))
    out += [raw("network_type").alias("network_type"), F.col("meta").alias("metadata")]
    res = x.select(*out)
    if convert_speed_ms:
        # N6 (opt-in; the reference loader leaves speed_ms unconverted).
        res = res.withColumn(
            "speed_mph",
            F.when(F.col("speed_ms").isNotNull(), F.col("speed_ms") * C.MS_TO_MPH).otherwise(F.col("speed_mph")),
        )
    return res


def read_raw_documents(spark: SparkSession, path: str, pattern: str = "*.json",
                       json_lines: bool = False) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if not json_lines:
        reader = reader.option("wholetext", True)
    text = reader.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    if json_lines:
        # no line numbers inside a file: a line is told by its content, equal ones by their number
        return content_ids(text.filter(F.trim("value") != ""), "doc_no", F.col("value"), ["file_path"])
    return text.withColumn("doc_no", F.lit("0"))


def read_readings_json(spark: SparkSession, path: str, pattern: str = "*.json",
                       json_lines: bool = False, convert_speed_ms: bool = False) -> DataFrame:
    """Load every JSON document under ``path`` into normalised readings.

    A file that cannot be parsed yields no trips (the reference logs and skips it).
    """
    docs = parse_documents(read_raw_documents(spark, path, pattern, json_lines))
    return normalize_readings(docs, convert_speed_ms=convert_speed_ms)
