"""Sum-of-squares packing of token sequences.

Documents become ids (tokenizers library, end id appended); only those longer
than a sequence are cut. Each piece goes where the sum over all residual gaps
of the squared number of open sequences with that gap becomes smallest, a new
sequence being one of the choices (full sequences don't count).

Pieces are dealt into groups of about `group` by hash, so that every group has
the corpus's mix of lengths, and a group packs longest first. Sequences that
a group leaves with a gap are opened again: their pieces go into further
round with groups drawn anew (`rounds` says how many there are). Only
lengths travel for this; ids never shuffle unless a caller keeps them in the
frame.

Edge cases: null text is empty, a document of the end id alone; a document of
exactly one sequence is one piece; ties fall to the smaller gap; repeated rows
are packed as often as they occur; null doc_ids are ids; an empty table gives
an empty result; other columns pass through `pack` (names with two leading
underscores, sequence_id and offset are its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, tidy
from .tokenize import encoder


#: pieces of text whose ids a worker remembers (some 50 MB)
KEEP = 240_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): ids as unsigned 32-bit integers."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(tokenizer, KEEP)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            for k in range(0, len(b), 256):
                out = []
                texts = [t or "" for t in b.column("text").slice(k, 256).to_pylist()]
                for d, ids in zip(b.column("doc_id").slice(k, 256).to_pylist(), enc.ids_of(texts)):
                    ids += end
                    n = len(ids) // 4
                    for p, s in enumerate(range(0, n, limit)):
                        out.append((d, p, s, min(limit, n - s), ids[4 * s:4 * (s + limit)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each length, offset of each, gap of each bin) for lengths in the given order."""
    open_ = np.zeros(limit + 1, np.int64)  # open bins per gap
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        # squares' change: the bin leaves gap g (1 - 2 open[g]) and joins gap g - s (1 + 2 open[g - s])
        there = np.flatnonzero(open_[s:]) + s
        new = 1 + 2 * open_[limit - s] if s < limit else 0
        best, where = new, -1
        if len(there):
            left = there - s
            change = 1 - 2 * open_[there] + np.where(left > 0, 1 + 2 * open_[left], 0)
            j = int(change.argmin())
            if change[j] <= new:
                best, where = change[j], int(there[j])
        if where < 0:
            b, where = len(gaps), limit
            gaps.append(limit)
        else:
            b = stacks[where].pop()
            open_[where] -= 1
        bins[i], offsets[i] = b, limit - where
        gaps[b] = where - s
        if where > s:
            stacks[where - s].append(b)
            open_[where - s] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pack(pieces: DataFrame, limit: int = 4096, group: int = 4096, rounds: int = 2, seed: int = 11) -> DataFrame:
    """``pieces`` (any columns, with length <= limit) plus sequence_id and offset.

    ``group``: pieces a task packs together; ``rounds``: at most so many
    rounds, each over the sequences that the last left open."""
    ship(pieces.sparkSession)
    cols = [c for c in pieces.columns]
    todo = checkpoint(pieces.withColumn("__row", F.monotonically_increasing_id()))
    schema = f"{_ddl(todo)}, sequence_id long, offset long, __gap long"
    done = None
    for r in range(rounds):
        n = todo.count()
        if not n:
            break
        groups = max(1, round(n / group))

        dealt = todo.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed + r), F.col("__row")), F.lit(groups)))
        out = checkpoint(dealt.groupBy("__group").applyInPandas(_pack_group(r, limit), schema))
        if r + 1 < rounds:
            full = out.filter("__gap = 0").drop("__gap")
            todo = out.filter("__gap > 0").select(*todo.columns)
        else:
            full = out.drop("__gap")
        done = full if done is None else done.unionByName(full)
        if r + 1 == rounds:
            break
    if done is None:
        done = todo.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return done.select(*cols, "sequence_id", "offset")


def _pack_group(r: int, limit: int):
    def run(key, pdf):
        order = np.lexsort((pdf["__row"].to_numpy(), -pdf["length"].to_numpy()))
        pdf = pdf.iloc[order].drop(columns="__group")
        bins, offsets, gaps = sum_of_squares(pdf["length"].to_numpy(), limit)
        # number of the sequence: round, group, bin
        return pdf.assign(sequence_id=((r << 58) + (int(key[0]) << 24) + bins), offset=offsets, __gap=gaps[bins])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    p = token_pieces(docs, tokenizer, end_id, limit)
    return pack(p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), limit)
