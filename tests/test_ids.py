"""Ids of lines and scored rows depend on their content alone."""

from pyspark.sql import functions as F

from roadrisk.operators.scoring import score_predictions
from roadrisk.sources.readings_json import read_raw_documents, read_readings_json


def test_line_ids_stay_when_files_come_and_splits_change(spark, tmp_path):
    lines = ['{"trip_id": "a", "speed_mph": 1}', '{"trip_id": "b", "speed_mph": 2}', '{"trip_id": "a", "speed_mph": 1}', "", "not json"] * 3
    (tmp_path / "x.json").write_text("\n".join(lines))
    def ids():
        d = read_raw_documents(spark, str(tmp_path), json_lines=True).filter(F.col("file_path").endswith("x.json"))
        return sorted((r.value, r.doc_no) for r in d.collect())
    first = ids()
    assert len({i for _, i in first}) == len(first) == 12
    (tmp_path / "w.json").write_text("\n".join(lines[::-1]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert ids() == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # each line is a trip of its own
    r = read_readings_json(spark, str(tmp_path), json_lines=True)
    assert r.count() == r.select("trip_key").distinct().count() == 18


def test_default_trip_ids_are_the_same_after_a_repartition(spark):
    d = spark.range(50).select((F.col("id") % 20 / 40).alias("claim_probability"), F.lit(100.0).alias("claim_severity_prediction"))
    a, b = ([r.trip_id for r in score_predictions(x).orderBy("trip_id").collect()] for x in (d.repartition(2), d.repartition(9)))
    assert a == b and len(set(a)) == 50 and all(i.startswith("trip_") for i in a)
