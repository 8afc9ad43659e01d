"""Skew-safe operators equal their single-task definitions; plan shape checks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadrisk.functions.ordered import ordered_lags
from roadrisk.functions.prefix import ordered_prefix_sums, ranged_prefix_sums
from roadrisk.plans import views
from roadrisk.plans.catalog import load_all, QUERIES
from tests.conftest import SF


def test_ordered_lags_equals_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 3), s, rnd.randint(0, 1)) for s in rnd.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "k int, seq long, v int")
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select("k", "seq", F.lag("v", 1).over(w).alias("a"), F.lag("v", 2).over(w).alias("b"))
    for width in (1, 7, 50, 1 << 20):
        got = ordered_lags(df, ["k"], "seq", ["v"], 2, width).select(
            "k", "seq", F.col("v_lag1").alias("a"), F.col("v_lag2").alias("b"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_prefix_sums_equal_window(spark):
    rnd = random.Random(5)
    rows = [(float(i) + rnd.random(), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, x long")
    want = df.select("s", F.sum("x").over(Window.orderBy("s")).alias("cum_x"))
    got = ordered_prefix_sums(df, "s", ["x"], buckets=9).select("s", "cum_x")
    assert got.exceptAll(want).count() == 0


def test_scan_is_pruned_and_filters_pushed(spark):
    load_all()
    plan = QUERIES["trip_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" in plan and "o_comment" not in plan
    t = views.derive_trips(spark, SF).filter(F.col("trip_date") >= "1997-01-01")
    p = t._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_shuffles_for_trip_fold(spark):
    """readings -> trips: the full-width readings are shuffled once (by trip
    key + order bucket); a 4-column projection feeds the bucket tails, the
    carry table is shuffled by trip, and the fold ships partial aggregates."""
    load_all()
    df = QUERIES["trip_summary"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trip_key") <= 4
    assert plan.count("Window [") + plan.count("Window (") >= 1


def test_exact_quantiles_equal_percentile(spark):
    from roadrisk.functions.quantiles import exact_quantiles
    rnd = random.Random(11)
    rows = [(float(rnd.randint(0, 40)) if rnd.random() > 0.05 else None,) for _ in range(700)]
    df = spark.createDataFrame(rows, "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    want = df.agg(F.percentile("x", probs)).first()[0]
    for accuracy in (20, 200, 10_000):
        got = exact_quantiles(df, "x", probs, accuracy=accuracy).first()[0]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(empty, "x", [0.5]).first()[0] == [None]


def test_grouped_quantiles_keep_only_bracketed_values(spark):
    from roadrisk.functions.quantiles import _cells, _sketches, exact_quantiles
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    # distinct values, ties, an own distribution per group, a group of nulls
    df = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "ties").otherwise("tail").alias("g"),
        F.when(F.col("id") % 3 == 0, F.rand(5)).when(F.col("id") % 3 == 1, F.col("id") % 7)
        .otherwise(F.exp(F.randn(6) * 4)).alias("x")).unionByName(
        spark.createDataFrame([("none", None)], "g string, x double"))
    df = df.checkpoint()
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect() if r.q}
    for accuracy in (100, 10_000):
        got = {r.g: r.q for r in exact_quantiles(df, "x", probs, out="q", by=["g"], accuracy=accuracy).collect()}
        assert got.keys() == want.keys()
        for g in want:
            assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[g], want[g]))
    small = df.filter("abs(hash(x)) % 500 = 0")
    want = {r.g: r.q for r in small.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect() if r.q}
    got = {r.g: r.q for r in exact_quantiles(small, "x", probs, out="q", by=["g"]).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for g in want for a, b in zip(got[g], want[g]))
    v = df.select("g", F.col("x").alias("__v")).filter("x IS NOT NULL")
    cells = _cells(v, _sketches(v, probs, ["g"], 10_000)[0], probs, ["g"], 10_000)
    assert cells.count() < 120_000 * 8 * len(probs) / 10_000 + 50
    # the values meet their group's sketch by broadcast, not by a shuffle on the group
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_quantiles_of_many_cells_run_in_ranges(spark):
    from roadrisk.functions.quantiles import exact_quantiles
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, "ties").alias("g"),
        F.when(F.col("id") % 3 > 0, F.exp(F.randn(6) * 4)).otherwise(F.col("id") % 7).alias("x")).checkpoint()
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect()}
    whole = df.agg(F.percentile("x", probs)).first()[0]

    def same(a, b):
        return all(abs(p - q) <= 1e-9 * max(1.0, abs(q)) for p, q in zip(a, b))

    for accuracy, task_cells in ((100, 50), (10_000, 50), (10_000, 3)):
        grouped = exact_quantiles(df.filter("g IS NOT NULL"), "x", probs, out="q", by=["g"], accuracy=accuracy, task_cells=task_cells)
        got = {r.g: r.q for r in grouped.collect()}
        assert set(got) == {"hot", "ties"} and all(same(got[g], want[g]) for g in got)
        alone = exact_quantiles(df, "x", probs, accuracy=accuracy, task_cells=task_cells)
        assert same(alone.first()[0], whole)
        # cells are dealt by range before they are put in order
        assert "hashpartitioning(__range" in alone._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(empty, "x", [0.5], task_cells=0).first()[0] == [None]
    assert exact_quantiles(empty, "x", [0.5], by=["g"], task_cells=0).count() == 0


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_ranged_prefix_sums_at_any_number_of_ranges(spark, ranges):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("s"), (F.col("id") % 7).alias("x"))
    got = {r["s"]: (r["cum_x"], r["total_x"]) for r in ranged_prefix_sums(df.repartition(5), "s", ["x"], ranges).collect()}
    run, want = 0, {}
    rows = sorted((float(i * 37 % 1000), i % 7) for i in range(1000))
    for s, x in rows:
        run += x
        want[s] = (run, sum(x for _, x in rows))
    assert got == want
    assert ranged_prefix_sums(df.filter("false"), "s", ["x"], ranges).count() == 0
