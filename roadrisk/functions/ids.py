"""Row ids that depend on what a row holds, not on where it was read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounded import broadcast_if_small


def content_ids(df: DataFrame, out: str, content: Column, within: Sequence[str] = ()) -> DataFrame:
    """``df`` plus ``out``: hash of ``content`` and the place among equal ones (of the same ``within``).

    The same rows get the same ids however they are split or ordered, and when
    others come. Only hashes shuffle to find the ones that occur twice or more; only
    rows with such a hash are then numbered (which of equal rows gets which number doesn't matter)."""
    keys = [*within, "__id_hash"]
    d = df.withColumn("__id_hash", F.md5(F.coalesce(content.cast("string"), F.lit(""))))
    again = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__id_n")).filter("__id_n > 1")
    d = d.join(broadcast_if_small(again), keys, "left")
    w = Window.partitionBy(*keys).orderBy("__id_n")
    more = d.filter("__id_n > 1").withColumn("__id_place", F.row_number().over(w) - 1)
    rows = d.filter("__id_n is null").withColumn("__id_place", F.lit(0)).unionByName(more)
    return rows.select(*df.columns, F.concat_ws("-", "__id_hash", F.col("__id_place").cast("string")).alias(out))
