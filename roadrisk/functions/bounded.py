"""Broadcasts behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def local_if_small(df: DataFrame, look, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, object]:
    """``df`` computed and marked for broadcast if it has at most ``rows`` rows, with
    ``look`` of its Arrow table; otherwise as it was, for AQE to join as sizes turn
    out, with None.

    For per-group tables: a join on the group key alone would shuffle the big
    side onto as many tasks as there are groups."""
    few = df.limit(rows + 1).toArrow()
    if few.num_rows > rows:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(few, df.schema)), look(few)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as ``local_if_small`` gives it."""
    return local_if_small(df, lambda few: None, rows)[0]
