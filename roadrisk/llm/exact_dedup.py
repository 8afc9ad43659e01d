"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Pass 1 hashes every normalised text into the cells of a Bloom filter, counts
the rows of each cell (map-side combined, eight bytes a cell) and keeps the
cells that at least two rows hit, packed into 64-bit words. Pass 2 looks every
row up in those words, which are broadcast (their number is bounded by the
filter's size): a row with a cell that only it hits can have no equal and
passes straight on; only the others shuffle, by SHA-256 of the text. What the
filter lets through wrongly costs a little shuffle, never a wrong result.

Edge cases: null text is the empty text, and all empty texts are equal; of
equal texts the row with the largest doc_id stays, and null doc_ids lose to
all others; rows repeated under one doc_id stand for one document, so all are
marked kept in `duplicate_groups`, and `exact_dedup` leaves one of them; an empty
table gives an empty result; other columns pass through (names that begin
with two underscores are reserved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (attach_group_stats, bloom_cells, bloom_hit, bloom_size, bloom_words, checkpoint, lower_ascii,
                     text_or_empty)


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(lower_ascii(text_or_empty()), 256).alias("text_sha256"))


def _key(sha: str = "text_sha256"):
    return F.xxhash64(sha)


def repeated_words(digests: DataFrame, rows: int, bits_per_row: int = 16, max_bits: int = 1 << 27):
    """Pass 1: (words of the cells hit at least twice, bits of a filter)."""
    bits = bloom_size(rows, bits_per_row, max_bits)
    cells = digests.select(F.explode(F.array(*bloom_cells(_key(), bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    return bloom_words(twice), bits


def duplicate_groups(docs: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    d = checkpoint(_digests(docs))
    words, bits = repeated_words(d, d.count(), bits_per_row, max_bits)
    f = bloom_hit(d, _key(), words, bits, "__maybe")
    alone = f.filter(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    some = attach_group_stats(
        f.filter("__maybe").drop("__maybe"), ["text_sha256"],
        {"keep_id": (F.max("doc_id"), F.max), "group_size": (F.count("*"), F.sum)}, ["doc_id"])
    return alone.unionByName(some.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 27) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one for each different text.

    Rows the filter clears are read, tested and passed on in one narrow stage;
    the rest shuffle by (text, salt) to meet their group's largest doc_id."""
    d = checkpoint(_digests(docs))
    words, bits = repeated_words(d, d.count(), bits_per_row, max_bits)
    # a null id counts as the smallest one, so that it joins
    row_id = F.coalesce("doc_id", F.lit(-(1 << 63)))
    whole = docs.withColumn("__sha", F.sha2(lower_ascii(text_or_empty()), 256)).withColumn("__id", row_id)
    f = bloom_hit(whole, _key("__sha"), words, bits, "__maybe")
    alone = f.filter(~F.col("__maybe")).select(*docs.columns)
    # the one id that stays for each text, from the narrow digests
    maybe = bloom_hit(d, _key(), words, bits, "__maybe").filter("__maybe")
    keep = maybe.groupBy(F.col("text_sha256").alias("__sha")).agg(F.max(row_id).alias("__id"))
    some = f.filter("__maybe").join(keep, ["__sha", "__id"], "left_semi")
    return alone.unionByName(some.dropDuplicates(["__sha", "__id"]).select(*docs.columns))
