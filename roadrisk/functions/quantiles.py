"""Exact quantiles in two passes, without shuffling the values.

``percentile(x, p)`` merges a value->count map of every distinct value in
one final task. Here pass 1 takes mergeable sketches (``percentile_approx``,
map-side) that bracket every probability from below and above. Pass 2 counts
rows per value inside the brackets and only per gap outside them, so that what
shuffles is one partial row a gap and task plus the bracketed values: about
8 / accuracy of a group's rows for each probability (groups of at most
``accuracy`` rows, where a bracket would be narrower than a rank, are counted
by value). Running counts over those
cells give the exact values at ranks floor((n-1)p) and ceil((n-1)p) and their
linear interpolation, the definition shared by Spark's ``percentile``, DuckDB's
``quantile_cont`` and pandas. How many cells a group can have is known from pass
1; where that is more than a task's worth, its cells are cut into ranges that
run in parallel and meet as one total each. Brackets reach a little beyond the sketched
values, since sums of doubles may come out with other last bits when the input
is computed again. A rank outside its bracket (the sketch's error bound forbids
it) is an error, never a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounded import local_if_small

#: a bracket reaches this many times the sketch's error bound to either side
MARGIN = 4
#: cells of a group that one task may put in order
TASK_CELLS = 1_000_000
#: most ranges that a group's cells are cut into
RANGES = 1024


def exact_quantiles(df: DataFrame, column, probs: Sequence[float], out: str = "quantiles", by: Sequence[str] = (),
                    accuracy: int = 10_000, task_cells: int = TASK_CELLS) -> DataFrame:
    """One row (per ``by`` group with a non-null value) with an array column
    `out` of the quantiles in `probs` order; without ``by`` one row always,
    its entries NULL when there is no non-null value. Pass 1 runs while the plan is built."""
    x = F.col(column) if isinstance(column, str) else column
    probs, by = [float(p) for p in probs], list(by)
    v = df.select(*by, x.cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    sketches, largest = _sketches(v, probs, by, accuracy)
    cells = _cells(v, sketches, probs, by, accuracy)
    # a sketch may err by its bound on top of the bracket's width
    most = max(accuracy, 2 * (MARGIN + 1) * len(probs) * (largest or 0) / accuracy)
    if largest is not None and most <= task_cells:
        upto = Window.partitionBy(*by).orderBy("__x", "__gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = cells.withColumns({"__cum": F.sum("__c").over(upto), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    else:
        ranked = _ranged_ranks(cells, by, task_cells)
    value = F.when(F.col("__gap") == 0, F.col("__x")).otherwise(
        F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))

    def at(rank):  # rank r (0-based) lives in the cell with cum - count <= r < cum
        return F.max(F.when((F.col("__cum") - F.col("__c") <= rank) & (rank < F.col("__cum")), value))

    pos = [(F.col("__n") - 1) * p for p in probs]
    got = ranked.groupBy(*by).agg(
        F.max("__n").alias("__n"),
        *[at(F.floor(p)).alias(f"__lo{i}") for i, p in enumerate(pos)],
        *[at(F.ceil(p)).alias(f"__hi{i}") for i, p in enumerate(pos)])
    between = [
        F.when(F.ceil(p) == F.floor(p), F.col(f"__lo{i}")).otherwise(
            (F.ceil(p) - p) * F.col(f"__lo{i}") + (p - F.floor(p)) * F.col(f"__hi{i}"))
        for i, p in enumerate(pos)]
    return got.select(*by, F.array(*between).alias(out))


def _ranged_ranks(cells: DataFrame, by: list[str], task_cells: int) -> DataFrame:
    """``cells`` with running counts __cum and the group's rows __n. A group of more than
    ``task_cells`` cells is cut at quantiles of its different values, into as many ranges
    as it needs and at most RANGES; dealing by (group, range) keeps a hot group apart."""
    cuts = [i / RANGES for i in range(1, RANGES)]
    step = F.ceil(F.lit(RANGES) / F.ceil(F.col("__cells") / F.lit(task_cells)))
    bounds = cells.groupBy(*by).agg(F.count("*").alias("__cells"), F.percentile_approx("__x", cuts, 10 * RANGES).alias("__b")) \
        .filter(F.col("__cells") > task_cells) \
        .select(*by, F.filter("__b", lambda b, i: (i + 1) % step == 0).alias("__b"))
    placed = cells.join(bounds, by, "left") if by else cells.join(F.broadcast(bounds), how="left")
    placed = placed.withColumn("__range", F.when(F.col("__b").isNull(), 0).otherwise(
        F.size(F.filter("__b", lambda b: b < F.col("__x"))))).drop("__b").repartition(*by, "__range")
    group, place = Window.partitionBy(*by), [*by, "__range"]
    totals = placed.groupBy(*place).agg(F.sum("__c").alias("__t"))  # at most RANGES rows a group
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*place, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"),
                           F.sum("__t").over(group).alias("__n"))
    local = Window.partitionBy(*place).orderBy("__x", "__gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("__local", F.sum("__c").over(local)).join(totals, place).withColumn(
        "__cum", F.col("__local") + F.col("__off"))


def _sketches(v: DataFrame, probs: list[float], by: list[str], accuracy: int) -> tuple[DataFrame, int | None]:
    """Pass 1: per group its rows, largest size and sketched values around each probability;
    and the rows of the largest group (None when there are too many groups to look)."""
    m = MARGIN / accuracy
    around = [min(1.0, max(0.0, q)) for p in probs for q in (p - m, p + m)]
    size = F.abs("__v")
    s = v.groupBy(*by).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", around, accuracy).alias("__s"),
                           F.max(F.when(size < float("inf"), size)).alias("__max"))
    return local_if_small(s, lambda few: max(few.column("__n").to_pylist(), default=0))


def _cells(v: DataFrame, sketches: DataFrame, probs: list[float], by: list[str], accuracy: int) -> DataFrame:
    """Pass 2: (by, __x, __gap, __c): rows of each bracketed value (__gap 0),
    and of each gap (1), filed under the bracket end below it."""
    m = MARGIN / accuracy
    x, s = F.col("__v"), F.col("__s")

    def slack(e):
        return F.abs(e) * 1e-9 + F.coalesce("__max", F.lit(0.0)) * 1e-15

    # NaN is above all values in Spark's order
    low = [s[2 * i] - slack(s[2 * i]) if p - m > 0 else F.lit(float("-inf")) for i, p in enumerate(probs)]
    high = [s[2 * i + 1] + slack(s[2 * i + 1]) if p + m < 1 else F.lit(float("nan")) for i, p in enumerate(probs)]
    inside, below = F.col("__n") <= accuracy, [F.lit(float("-inf")), F.lit(float("-inf"))]
    for lo, hi in zip(low, high):
        inside = inside | ((lo <= x) & (x <= hi))
        below.append(F.when(hi < x, hi))
    j = v.join(sketches, by) if by else v.crossJoin(sketches)
    return j.select(
        *by, F.when(inside, x).otherwise(F.greatest(*below)).alias("__x"),
        F.when(inside, 0).otherwise(1).alias("__gap")).groupBy(*by, "__x", "__gap").agg(F.count("*").alias("__c"))


def exact_quantile(df: DataFrame, column, prob: float, out: str = "quantile") -> DataFrame:
    """1-row DataFrame with the single quantile as a double column."""
    return exact_quantiles(df, column, [prob]).select(F.col("quantiles")[0].alias(out))
