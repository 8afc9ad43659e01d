"""Token-id output: one shared zstandard dictionary, every document a frame of its own.

File format (Parquet files in one folder, written by Spark's committer):

* `dictionary/`: one row: dict_hash (SHA-256 of the dictionary), the dictionary,
  the tokenizer's name and the ids' width in bytes (2 or 4);
* `blocks/`: one row per block of consecutive documents: shard, block (number
  within the shard), dict_hash, first_doc and last_doc, shard_ids (ids of the
  shard before this block), the offset index (doc_ids, offsets into payload
  with the end last, n_tokens) and payload, the documents' frames end to end.

Shards are ranges of doc_id, as many as the bytes of the texts ask for, so (shard, block, place) is ascending doc_id
order. A short document is read by itself: `read_documents` filters on
first_doc and last_doc, which reaches the Parquet scan, and unpacks one frame;
reading only the index never touches the payload column.

The dictionary is trained on the serialised ids of a bounded sample: the
`sample` documents (of at most `sample_chars` characters; the dictionary
serves short documents) with the smallest hashes of their doc_ids. It only
affects size. With too little to train on, the dictionary is empty.

Edge cases: null text is empty and gives the end id alone; equal doc_ids stand
side by side, ordered by length, then hash of the text; null doc_ids come
first; a very long document is a block of its own; an empty table gives an
empty store; other columns aren't written.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .tokenize import encoder

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
#: bytes of text a shard is meant to hold, and how many shards there may be before they grow beyond that
SHARD_BYTES = 32 << 20
MOST_SHARDS = 20_000


def _frame_ids(ids: bytes, end_id: int, width: int) -> bytes:
    a = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
    return a.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int = 1024,
                     sample_chars: int = 20_000, size: int = 65_536) -> bytes:
    """Dictionary from the ids of at most ``sample`` documents of at most
    ``sample_chars`` characters (that bounds what comes to the driver)."""
    import zstandard
    picked = docs.select("doc_id", text_or_empty().alias("text")).filter(F.char_length("text") <= sample_chars) \
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "text").limit(sample)

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_frame_ids(x, end_id, width) for x in enc.ids_of(b.column("text").to_pylist())], pa.binary())], names=["ids"])

    rows = [bytes(r.ids) for r in picked.select("text").mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, rows)) // 10)), rows, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def shards_for(docs: DataFrame, shard_bytes: int = SHARD_BYTES, most: int = MOST_SHARDS) -> int:
    """Ranges to cut ``docs`` into: by the bytes of their texts, so that what a task reads doesn't
    grow with the table; no fewer than the cluster has cores, unless a range had less than 1 MB."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty()).cast("long"))).first()[0] or 0
    busy = min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20)))
    return max(1, min(most, max(busy, -(-size // shard_bytes))))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3,
                shard_bytes: int = SHARD_BYTES) -> None:
    """Tokenise all ``docs`` and write the store. Texts shuffle once, into ranges of doc_id
    of some ``shard_bytes`` each."""
    import zstandard
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    ship(spark)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary), os.path.basename(tokenizer), width)],
                          "dict_hash string, dictionary binary, tokenizer string, width int") \
        .write.mode("overwrite").parquet(f"{path}/dictionary")

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        block, before = 0, 0
        ids, sizes, counts = [], [], []
        payload = bytearray()

        def flush():
            nonlocal block, before, ids, sizes, counts, payload
            row = {"shard": [shard], "block": [block], "dict_hash": [dict_hash], "first_doc": [ids[0]], "last_doc": [ids[-1]],
                   "shard_ids": [before], "doc_ids": [ids], "offsets": [np.concatenate([[0], np.cumsum(sizes)])],
                   "n_tokens": [counts], "payload": [bytes(payload)]}
            block, before = block + 1, before + sum(counts)
            ids, sizes, counts, payload = [], [], [], bytearray()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for b in batches:
            for k in range(0, len(b), 256):
                doc_ids = b.column("doc_id").slice(k, 256).to_pylist()
                for d, raw in zip(doc_ids, enc.ids_of(b.column("text").slice(k, 256).to_pylist())):
                    frame = zip_.compress(_frame_ids(raw, end_id, width))
                    ids.append(d)
                    sizes.append(len(frame))
                    counts.append(len(raw) // 4 + 1)
                    payload += frame
                    if len(payload) >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield flush()
        if ids:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("first_doc", pa.int64()),
                        ("last_doc", pa.int64()), ("shard_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
    ddl = ("shard int, block int, dict_hash string, first_doc long, last_doc long, shard_ids long, doc_ids array<long>, "
           "offsets array<long>, n_tokens array<long>, payload binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("__n"), F.col("__h")]
    parts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
        .withColumns({"__n": F.char_length("text"), "__h": F.xxhash64("text")}) \
        .repartitionByRange(shards_for(docs, shard_bytes), *order).sortWithinPartitions(*order).select("doc_id", "text")
    parts.mapInArrow(run, ddl).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dict_hash, bytes(row.dictionary), row.width


def read_blocks(blocks: DataFrame, path: str, only: set[int] | None = None) -> DataFrame:
    """(shard, block, place, doc_id, before, ids): every document of ``blocks``,
    unpacked; ``before``: ids of the shard before it, ids: unsigned 32-bit."""
    import zstandard
    spark = blocks.sparkSession
    ship(spark)
    dict_hash, dictionary, width = _dictionary(spark, path)

    def run(batches):
        zip_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for r in range(len(b)):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                if row["dict_hash"] != dict_hash:
                    raise ValueError(f"block {row['shard']}/{row['block']} was written with another dictionary")
                at, out = row["shard_ids"], {n: [] for n in ("place", "doc_id", "before", "ids")}
                for place, (d, n) in enumerate(zip(row["doc_ids"], row["n_tokens"])):
                    if only is None or d in only:
                        frame = row["payload"][row["offsets"][place]:row["offsets"][place + 1]]
                        ids = np.frombuffer(zip_.decompress(frame), "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
                        for x, v in zip(out, (place, d, at, ids)):
                            out[x].append(v)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(out["ids"]), pa.int32()), pa.array([row["block"]] * len(out["ids"]), pa.int32()),
                     pa.array(out["place"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.array(out["before"], pa.int64()),
                     pa.array(out["ids"], pa.binary())], names=["shard", "block", "place", "doc_id", "before", "ids"])

    return blocks.select("shard", "block", "dict_hash", "shard_ids", "doc_ids", "offsets", "n_tokens", "payload").mapInArrow(
        run, "shard int, block int, place int, doc_id long, before long, ids binary")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): all documents; ``start``: ids of all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("shard").agg(F.sum("n").alias("n"))
    # one row per shard, that is per task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return read_blocks(blocks, path).join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "ids")


def read_documents(spark: SparkSession, path: str, doc_ids) -> DataFrame:
    """(doc_id, ids) of some documents: reads the blocks that hold them, unpacks only their frames."""
    wanted = {int(d) for d in doc_ids}
    hit = F.lit(False)
    for d in sorted(wanted):
        hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    return read_blocks(spark.read.parquet(f"{path}/blocks").filter(hit), path, wanted).select("doc_id", "ids")


def token_digests(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the store, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
