import zlib

import numpy as np

from roadrisk.llm import quality_rank as Q
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_given_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([p == q for _, p, q in held]) > 0.95


def test_never_learns_from_held_out_rows_or_other_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    import pyspark.sql.functions as F
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    blind = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")})
    a, b = (Q.train(d, x) for d, x in ((docs, labels), (blind, turned)))
    assert all(np.allclose(x, y) for x, y in zip(a, b))


def test_pairs_recover_a_known_ranking():
    rng = np.random.default_rng(0)
    true = np.zeros(len(Q.FEATURES))
    true[:3] = [2, -1, 0.5]
    x = rng.standard_normal((4000, len(true)))
    y = rng.random(4000) < 1 / (1 + np.exp(-x @ true))
    m = Q.fit(x[y], x[~y])
    assert np.corrcoef(m.weights, true)[0, 1] > 0.95
    s = m.score(x)
    # the threshold is the quantile of label 0's share
    assert abs((s < 0.3).mean() - (~y).mean()) < 0.001 and ((s >= 0.3) == ((x - m.centre) / m.spread @ m.weights >= m.threshold)).all()


def test_weighted_quantile_is_that_of_repeated_rows():
    rng = np.random.default_rng(1)
    v, w = rng.standard_normal(200).round(1), rng.integers(1, 9, 200)
    for p in (0, 0.1, 0.142, 0.5, 0.99, 1):
        assert np.isclose(Q.weighted_quantile(v, w.astype(float), p), np.quantile(np.repeat(v, w), p))
        assert np.isclose(Q.weighted_quantile(v, np.ones(200), p), np.quantile(v, p))


def test_threshold_means_the_same_when_the_sample_is_capped(spark):
    # labels that the texts say nothing about: the share below the threshold is label 0's, not the sample's
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["ab", "Cde.", "fghi", "77", "jk,"], int(rng.integers(5, 60)))) for _ in range(1500)]
    docs = cases.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    for per_label in (10_000, 120):
        m = Q.train(docs, labels, per_label=per_label)
        assert abs(np.mean(m.score(np.array([Q.features(t) for t in texts])) < 0.3) - 1 / 8) < 0.06


def test_every_training_row_counts(spark):
    # label 1 is told by a mark that few texts hold, label 0 is rare: a sample of 40 of each label learns neither
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["ab", "Cde.", "fghi", "jk,"], int(rng.integers(20, 60)))) + (" 777" if i % 37 == 1 else "") for i in range(2000)]
    docs = cases.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 29 > 0), 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    learnt = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    x = np.array([Q.features(texts[i]) for i in learnt])
    q = np.array([int(i % 29 > 0) for i in learnt])
    whole = Q.train(docs, labels)
    assert np.allclose(whole.centre, x.mean(0)) and np.allclose(whole.spread[whole.spread != 1], x.std(0)[x.std(0) > 1e-9])
    one = Q.fit(*(np.array(sorted(x[q == k].tolist())) for k in (1, 0)))
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(whole, one))
    many = Q.train(docs, labels, per_label=40)
    assert np.allclose(many.centre, whole.centre) and np.allclose(many.spread, whole.spread)
    assert np.corrcoef(many.weights, whole.weights)[0, 1] > 0.95
    # the threshold is the exact quantile over all training rows
    assert np.isclose(many.threshold, np.quantile(many.strength(x), (q == 0).mean()))


def test_blocks_hold_every_row(spark):
    rows = spark.createDataFrame([(i, int(i % 50 > 0), [float(i)] + [0.0] * (len(Q.FEATURES) - 1)) for i in range(1000)], "id long, quality int, x array<double>")
    got = Q.training_blocks(rows, (20, 980), 100).collect()
    x0, x1 = ([set(r[c][::len(Q.FEATURES)]) for r in got] for c in ("x0", "x1"))
    assert len(got) == 10 and set.union(*x0) == set(range(0, 1000, 50)) and sum(map(len, x1)) == 980 == len(set.union(*x1))
    assert min(map(len, x0)) == 20  # the rare label's rows stand in every block


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 1), (5, None, 0), (None, 1, 0), (9, 7, 0), (100, 1, 0), (101, 1, 0), (200, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = Q.quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    none = spark.createDataFrame([], labels.schema)
    assert {(r.score, r.predicted) for r in Q.quality_scores(docs, none).collect()} == {(0.3, 1)}
    assert Q.quality_scores(cases.documents(spark, []), labels).count() == 0


def test_features_are_finite():
    for t in (None, "", " ", "a", "!!!", "A" * 100_000, "\n\n", "é" * 10, "word " * 50_000):
        f = Q.features(t)
        assert len(f) == len(Q.FEATURES) and np.isfinite(f).all()
