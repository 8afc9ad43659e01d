"""Splits, folds, search and the calibrated pipeline on small tables."""

import collections

import pytest
from pyspark.sql import functions as F

from roadrisk.operators import models as M

NAMES = ("f1", "f2", "f3")


@pytest.fixture(scope="module")
def table(spark):
    d = spark.range(600).select(
        F.col("id").alias("trip_id"), (F.col("id") % 7).alias("driver_id"),
        *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 1000).alias(n) for n in NAMES])
    return d.withColumn("has_claim", (F.col("f1") + 0.3 * F.col("f2") > 0.9).cast("int")) \
        .withColumn("claim_amount", F.when(F.col("has_claim") == 1, 1000 + 5000 * F.col("f3")).otherwise(0.0))


@pytest.fixture(scope="module")
def prob(table):
    return M.prepare_probability_data(table)


def test_places_are_exact_in_every_class_and_range(spark, monkeypatch):
    d = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 10 < 9, 0).alias("label"))
    def both(): return sorted((r.id, r.place, r.n_class) for r in M.hash_places(d, "id", "label").collect())
    whole = both()
    monkeypatch.setattr(M, "RANGE_ROWS", 30)  # many ranges give the same places
    assert both() == whole
    by = collections.defaultdict(list)
    for r in M.hash_places(d, "id", "label").collect():
        by[r.label].append(r.place)
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(len(v))) for k, v in by.items()} and set(by) == {0, 1, None}
    s = M.place_split(d, "id", "label", train=0.8, k=5).repartition(7).collect()
    n = collections.Counter((r.label, r.split) for r in s)
    assert n[0, "train"] == 640 and n[1, "train"] == 80 and n[None, "train"] == 80
    folds = collections.Counter((r.label, r.fold) for r in s if r.split == "train")
    assert {folds[1, f] for f in range(5)} == {16} and {folds[0, f] for f in range(5)} == {128}
    assert all((r.fold is None) == (r.split == "test") for r in s) and sum(r.is_validation for r in s) == 64 + 8 + 8


def test_boosting_stops_early(prob):
    train = prob.filter("split = 'train'")
    m = M.fit_probability(train, params={"maxIter": 60, "maxDepth": 5, "stepSize": 0.5}, features=NAMES)
    assert 1 <= M.tree_count(m) < 60
    auc = M.evaluate_probability(M.predict_probability(m, prob.filter("split = 'test'"))).first()["roc_auc"]
    assert auc > 0.9


def test_search_gives_the_same_rows_again(spark, prob, table):
    def rows(): return [tuple(r) for r in M.random_search(prob.filter("split = 'train'"), "probability", n=3, k=2, features=NAMES).collect()]
    first = rows()
    assert rows() == first and sorted(r[2] for r in first) == [1, 2, 3] and len({r[3] for r in first}) == 3
    assert len({k for s in M.sampled_settings(20) for k in s}) == 7 and M.sampled_settings(5) == M.sampled_settings(20)[:5]
    best = [r[5] for r in sorted(first, key=lambda r: r[2])]
    assert best == sorted(best, reverse=True) and best[0] > 0.6
    sev = M.prepare_severity_data(table).filter("split = 'train'")
    got = sorted(M.random_search(sev, "severity", n=2, k=2, features=NAMES).collect(), key=lambda r: r["rank"])
    assert got[0]["mean"] <= got[1]["mean"] and got[0]["metric"] == "rmse"


def test_cross_validation_of_both_targets(prob, table):
    p = {r["metric"]: r for r in M.cross_validate(prob.filter("split = 'train'"), "probability", k=5, features=NAMES, params={"maxIter": 5}).collect()}
    assert p["roc_auc"]["mean"] > 0.9 and p["f1"]["folds"] == 5 and p["f1"]["std"] > 0
    s = M.cross_validate(M.prepare_severity_data(table).filter("split = 'train'"), "severity", features=NAMES, params={"maxIter": 5}).collect()
    assert [r["metric"] for r in s] == ["rmse"]


def test_calibrated_pipeline_saves_and_loads(prob, tmp_path):
    m = M.fit_calibrated_probability(prob.filter("split = 'train'"), features=NAMES, params={"maxIter": 8, "maxDepth": 3})
    path = M.save_model(m, "p", 1, str(tmp_path))
    a, b = (M.predict_calibrated(x, prob).orderBy("trip_id").collect() for x in (m, M.load_model(path)))
    assert a == b and all(0 <= r["claim_probability"] <= 1 for r in a)
    with pytest.raises(Exception):  # a version is written once
        M.save_model(m, "p", 1, str(tmp_path))
    # calibrated: the mean probability is near the rate of claims, which class weights would shift
    rate = sum(r["label"] for r in a) / len(a)
    assert abs(sum(r["claim_probability"] for r in a) / len(a) - rate) < 0.05
    assert not [c for c in m.transform(prob).columns if c.startswith("__cal_")]


def test_a_failed_fit_is_a_row(prob):
    def fit(train, kind, features):
        if kind == "random_forest":
            raise ValueError("no trees today")
        return M.fit_probability(train, kind, {"maxIter": 5} if kind == "gbt" else None, features)
    got = {r["algorithm"]: r for r in M.normalised_comparison(
        M.compare_algorithms(prob, "claim_probability", ("gbt", "random_forest", "logistic_regression"), fit, NAMES), "roc_auc").collect()}
    assert got["random_forest"]["error"] == "ValueError: no trees today" and got["random_forest"]["value"] is None
    assert got["gbt"]["value"] > 0.9 and got["logistic_regression"]["error"] is None and min(g["normalised"] for g in got.values() if g["error"] is None) == 0


def test_version_lookup(spark):
    rows = None
    for name, v in (("a", 1), ("a", 2), ("a", 10), ("b", 1)):
        r = M.metrics_row(spark, name, v, "x", spark.range(1).select(F.lit(float(v)).alias("rmse")), ("f",))
        rows = r if rows is None else rows.unionByName(r)
    def at(*x): return [r["version_no"] for r in M.get_version(rows, *x).collect()]
    assert at("a") == [10] and at("a", 2) == [2] and at("a", "v1") == [1] and at("a", 3) == [] and at("c") == []


def test_partitions_of_a_fit_are_bounded():
    assert [M.fit_partitions(n) for n in (0, 1, 20_000, 20_001, 120_000)] == [1, 1, 1, 2, 6]
    # a tree level shuffles its histograms once per partition: 2,700 of them at 54 million rows before
    assert M.fit_partitions(9_000_000) == M.fit_partitions(54_000_000) == 64 and M.fit_partitions(10 ** 9) == 1000


def test_features_follow_once_the_rows_are_dealt(table):
    def derive(d): return d.withColumn("f4", F.col("f1") * 2)
    early, late = M.prepare_probability_data(derive(table)), M.prepare_probability_data(table, derive=derive)
    cols = sorted(early.columns)
    assert early.select(cols).collect() == late.select(cols).collect()


def test_fits_at_once(prob, monkeypatch):
    assert M._fits_at_once(prob, 8) == 8
    monkeypatch.setattr(M, "FIT_AT_ONCE", 1300)  # 600 rows
    assert M._fits_at_once(prob, 8) == 2
    monkeypatch.setattr(M, "FIT_AT_ONCE", 10)
    assert M._fits_at_once(prob, 8) == 1


def test_inputs_alone_are_written_for_a_fit(table):
    d = M.prepare_probability_data(table, derive=lambda d: d.withColumn("f4", F.col("f1") * 2))
    written = d._jdf.queryExecution().optimizedPlan().collectLeaves().head().output().mkString(",")
    assert "f1" in written and "f4" not in written and "f4" in d.columns


def test_folds_of_a_calibration_read_their_rows_once(prob):
    read = prob.sparkSession.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b
    n = prob.count()
    M.fit_calibrated_probability(prob.filter("split = 'train'").unionByName(prob.filter("split = 'test'").withColumn("fold", F.lit(0)))
                                 .mapInPandas(seen, prob.schema), 2, NAMES, {"maxIter": 1})
    assert read.value == n


def test_a_comparison_takes_the_boosted_trees_that_are_fitted(spark, monkeypatch):
    from roadrisk.plans import q_models as Q
    real, kinds = {"p": M.fit_probability, "s": M.fit_severity}, []

    def fit(which):
        def one(train, kind="gbt", params=None, features=M.FEATURE_NAMES):
            kinds.append(which + kind)
            if kind != "gbt":
                raise ValueError("left out")
            return real[which](train, kind, {"maxIter": 1}, features)
        return one
    monkeypatch.setattr(Q, "_FITTED", {})
    monkeypatch.setattr(M, "fit_probability", fit("p"))
    monkeypatch.setattr(M, "fit_severity", fit("s"))
    got = {r["algorithm"]: r["error"] for r in Q.q_model_comparison(spark, "/root/testdata/sf0.001").filter("name = 'claim_severity'").collect()}
    assert sorted(kinds) == ["pgbt", "plogistic_regression", "prandom_forest", "sgbt", "slasso", "slinear", "srandom_forest", "sridge"]
    assert got["gbt"] is None and got["ridge"] == "ValueError: left out"


def test_kept_rows_are_written_not_cached(prob):
    train = prob.filter("split = 'train'")
    want = sorted((r.f1, r.label, r.fold) for r in train.collect())
    with M._kept(train, "f1") as d:
        level = d.storageLevel  # a cached partition's batches stayed in the memory of the serializer before
        assert not level.useMemory and not level.useDisk and d.rdd.getNumPartitions() == train.rdd.getNumPartitions()
        assert sorted((r.f1, r.label, r.fold) for r in d.collect()) == want
        path = d.sparkSession._jvm.org.apache.hadoop.fs.Path(d._jdf.logicalPlan().rdd().getCheckpointFile().get())
        files = path.getFileSystem(d.sparkSession._jsc.hadoopConfiguration())
        assert files.exists(path)
    assert not files.exists(path)


def test_an_evaluation_makes_one_table_of_scores(spark):
    d = spark.range(200).select(F.col("id").alias("trip_id"), (F.col("id") % 3 == 0).cast("double").alias("label"),
                                F.when(F.col("id") % 50 != 0, (F.col("id") % 17) / 17).alias("claim_probability"))
    d = d.withColumn("predicted_label", (F.col("claim_probability") > 0.5).cast("int")).coalesce(1)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b
    ev = d.select(F.col("label").cast("int").alias("label"), F.col("claim_probability").alias("score"))
    M.score_table(d.mapInPandas(seen, d.schema), score="claim_probability").count()
    once, before = read.value, read.value
    got = M.evaluate_probability(d.mapInPandas(seen, d.schema)).first()
    assert read.value - before == once + 200  # a table for each area before, and the pass of the counts
    assert (got.roc_auc, got.average_precision) == (M.roc_auc(ev).first().roc_auc, M.average_precision(ev).first().average_precision)
