"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns that operators also make
    T.StructField("score", T.DoubleType()), T.StructField("kept", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("row", T.IntegerType()), T.StructField("length", T.StringType()), T.StructField("label", T.StringType()),
])


def texts() -> list[tuple]:
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "delta.", "und", "être", "ñandú", "x9", "10.0.0.7", "ß"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = some(30_000)
    near = some(400)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t", None, None, 4), (4, some(50), "en", "b", 1),
        (5, "Same Text here", "en", "b", 1), (6, "same text HERE", "en", "b", 1), (7, "same text here", "fr", "c", 1),
        (7, "same text here", "fr", "c", 1), (8, "ÊTRE one two", "fr", "c", 1), (9, "être one two", "fr", "c", 1),
        (10, long, "en", "a", len(long)), (11, long + " end", "en", "a", 1), (12, near, "de", None, 1),
        (13, near + " tail", "de", None, 1), (None, "no id at all", "de", None, 1), (None, "same text here", "de", "d", 1),
        (14, "a b", "en", "é", 1), (15, "a b", "en", "z", 1), (16, "one", "en", "z", 1), (17, "İstanbul  x  y", "tr", "z", 1),
    ]
    rows += [(100 + i, some(20 + i), "en", "hot", 1) for i in range(60)]
    rows += [(200 + i, "copy of the very same words again and again", "en", "hot", 1) for i in range(60)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, 0.5, "k", 1, 2, "l", "m") for r in rows], SCHEMA).repartition(3)


def fields(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def components(n: int, pairs) -> list[int]:
    """Smallest index reachable from each index."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
