"""Skew-safe row-order helpers.

A plain ``Window.partitionBy(trip).orderBy(seq)`` sends every reading of a
trip to one task. One device stream can hold a third of all readings, so the
row-lag operators here split each ordered group into buckets of sequence
numbers (``floor(seq / width)``), compute lags inside a bucket, and patch the
first rows of each bucket with a small *carry* table holding the last values
of the preceding buckets. The carry table has one row per bucket, so the only
data that crosses a key boundary is O(#buckets * n), never a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_lags(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: Sequence[str],
    n: int,
    bucket_width: int,
) -> DataFrame:
    """Add ``{v}_lag{j}`` (j = 1..n) = value of ``v`` j rows earlier within the
    group ``keys`` in ``seq`` order (NULL before the first row).

    Equivalent to ``lag(v, j) over (partition by keys order by seq)`` but no
    task ever holds more than one bucket of a group.
    """
    keys = list(keys)
    bk = "__obk"
    part = keys + [bk]
    d = df.withColumn(bk, F.floor(F.col(seq) / F.lit(bucket_width)))
    w = Window.partitionBy(*part).orderBy(seq)
    wall = Window.partitionBy(*part)
    d = (
        d.withColumn("__ov", F.struct(*[F.col(v) for v in values]))
        .withColumn("__orn", F.row_number().over(w))
        .withColumn("__ocnt", F.count(F.lit(1)).over(wall))
    )
    for j in range(1, n + 1):
        d = d.withColumn(f"__olag{j}", F.lag("__ov", j).over(w))

    # Last n values of every bucket (bounded: <= n rows per bucket).
    tails = (
        d.filter(F.col("__orn") > F.col("__ocnt") - n)
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("__ov").alias("v")))).alias("__tail"))
    )
    # Each non-empty bucket contributes >= 1 value, so the n preceding
    # buckets always hold the n values that precede this bucket.
    wk = Window.partitionBy(*keys).orderBy(bk).rowsBetween(-n, -1)
    carry = tails.select(
        *part, F.array_sort(F.flatten(F.collect_list("__tail").over(wk))).alias("__carry")
    ).filter(F.size("__carry") > 0)  # a group's first bucket, mostly its only one, takes nothing over
    d = d.join(carry, on=part, how="left")
    out_cols = []
    for j in range(1, n + 1):
        from_carry = F.try_element_at(F.col("__carry"), -(F.lit(j) - F.col("__orn") + 1).cast("int"))["v"]
        lagged = F.when(F.col("__orn") > j, F.col(f"__olag{j}")).otherwise(from_carry)
        for v in values:
            out_cols.append(lagged[v].alias(f"{v}_lag{j}"))
    temp = ["__ov", "__orn", "__ocnt", "__carry", bk] + [f"__olag{j}" for j in range(1, n + 1)]
    return d.select(*[c for c in d.columns if c not in temp], *out_cols)
