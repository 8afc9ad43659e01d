"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ship import ship  # noqa: F401 (the operators take it from here)
from ..sources.tables import checkpoint_dir, cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

checkpoint = cut_lineage


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def few_rows(size: int) -> dict[str, int]:
    """Options of a Parquet writer for very wide rows: row groups of about ``size``
    bytes however few rows that is, so that a reader holds few at a time."""
    return {"parquet.block.size": size, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task, after which the worker, which Spark
    keeps for later tasks and stages, gives its freed memory back."""
    def whole(batches):
        import ctypes
        import gc

        import pyarrow as pa
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does exactly that for pure ASCII and is
    much faster than ``translate``; the test compares bytes with characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[Column, Callable]],
                       salt_on: Sequence[str], lookup: DataFrame | None = None) -> DataFrame:
    """``df`` with per-group values, hot groups split.

    ``aggs`` maps an output name to (aggregate over rows, function that merges
    partial values). Rows are dealt by (keys, salt), the salt taken from
    ``salt_on``; a group meets only as its <= salts partial rows. ``lookup``,
    with at most one row for each of ``keys``, is left-joined to those. Keys
    must not be null."""
    keys = list(keys)
    n = shuffle_partitions(df.sparkSession)
    d = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(n)))
    part = d.groupBy(*keys, "__salt").agg(*[a.alias(f"__p_{k}") for k, (a, _) in aggs.items()])
    w = Window.partitionBy(*keys)
    tot = part.select(*keys, "__salt", *[m(f"__p_{k}").over(w).alias(k) for k, (_, m) in aggs.items()])
    if lookup is not None:
        tot = tot.join(lookup, keys, "left")
    return d.join(tot, [*keys, "__salt"]).drop("__salt")


# --- Bloom filters as tables of 64-bit words -------------------------------

#: hash functions a filter has
PROBES = 2


def bloom_size(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 27) -> int:
    """Bits of each probe's filter: a power of two, at most ``max_bits``."""
    return min(max_bits, 1 << max(10, (max(1, rows) * bits_per_row - 1).bit_length()))


def bloom_cells(h: Column, bits: int) -> list[Column]:
    """The cell of a 64-bit hash in each probe's filter (numbered apart)."""
    return [(F.shiftrightunsigned(h, 31 * i).bitwiseAND(F.lit(bits - 1)) + F.lit(i * bits)) for i in range(PROBES)]


def bloom_words(cells: DataFrame) -> DataFrame:
    """(cell) rows -> (word, mask): at most PROBES * bits / 64 rows."""
    return cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("mask"))


def bloom_hit(df: DataFrame, h: Column, words: DataFrame, bits: int, out: str) -> DataFrame:
    """Add boolean ``out``: every cell of ``h`` is set. The words are broadcast:
    their number is bounded by the filter's size, whatever the data."""
    d = df
    hit = F.lit(True)
    for i, cell in enumerate(bloom_cells(h, bits)):
        w = F.broadcast(words.select(F.col("word").alias(f"__w{i}"), F.col("mask").alias(f"__m{i}")))
        d = d.withColumn(f"__c{i}", cell).join(w, F.shiftright(F.col(f"__c{i}"), 6) == F.col(f"__w{i}"), "left")
        bit = F.expr(f"shiftleft(1L, cast(__c{i} & 63 as int))")
        hit = hit & F.coalesce(F.col(f"__m{i}").bitwiseAND(bit) != 0, F.lit(False))
    return d.withColumn(out, hit).drop(*[f"__{x}{i}" for i in range(PROBES) for x in "cwm"])


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``listed`` (null keys stay).

    Only rows that a Bloom filter of the listed keys lets through shuffle for
    the exact anti join; all others pass straight on."""
    listed = listed.select(key).filter(F.col(key).isNotNull()).distinct()
    bits = bloom_size(listed.count())
    words = bloom_words(listed.select(F.explode(F.array(*bloom_cells(F.xxhash64(key), bits))).alias("cell")))
    d = bloom_hit(df, F.xxhash64(key), words, bits, "__hit")
    rest = d.filter(~F.col("__hit") | F.col(key).isNull()).drop("__hit")
    hit = d.filter(F.col("__hit") & F.col(key).isNotNull()).drop("__hit").join(listed, key, "left_anti")
    return rest.unionByName(hit.select(*rest.columns))


# --- running sums in a global order -----------------------------------------

def running_starts(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows before this one in its ``by``
    group. Rows are dealt in ranges of (by, order), so a hot group is spread
    over many; ranges meet only as one total each. The result is checkpointed
    before the totals are taken: ranges can't move between the two readings."""
    by, order = list(by), list(order)
    n = shuffle_partitions(df.sparkSession)
    r = checkpoint(df.repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy(*by, "__range").agg(F.sum(value).alias("__t"))
    offsets = totals.select(*by, "__range", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    local = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(
        offsets, [*by, "__range"]).withColumn(out, F.col("__local") + F.col("__off")).drop("__local", "__off", "__range")


# --- connected components ----------------------------------------------------

def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star rounds, each one min-aggregate and
    one join, checkpointed; nodes without an edge aren't returned."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = checkpoint(e)
    n = e.count()
    if n == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def star(e: DataFrame, small: bool) -> DataFrame:
        # large: neighbours above u hang on the smallest around u; small: u and its lower neighbours do.
        # A node with very many neighbours is split by salt.
        both = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        j = attach_group_stats(both, ["u"], {"m": (F.min("v"), F.min)}, ["v"])
        if small:
            out = j.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        else:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        return out.filter("u <> v").distinct()

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    last = sign(e)
    for _ in range(max_rounds):
        e = checkpoint(star(star(e, False), True))
        now = sign(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
