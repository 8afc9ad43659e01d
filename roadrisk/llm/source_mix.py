"""Mixing sources to target weights, in fixed-length blocks.

1. Targets: every source has a weight; targets share the total size by weight,
   stop at `cap` times the source's size, and what that leaves over is shared
   again by weight until no target is above its cap.
2. Each source's words, in the order of its documents, are packed into blocks
   of `block` words (the last one may be shorter).
3. The mix is a row of slots, dealt over `shards` output shards. Shard by
   shard, the number of slots that each source fills is a multinomial draw,
   the chances being what each source still lacks of its target; so the shards
   vary as draws do, while the whole comes out at the targets.
4. A source's slots are numbered through; slot j reads block p(j), where p runs
   through the source's blocks in a pseudorandom order (a keyed permutation of
   the block indexes), then in another, so no block is read more than `cap`
   times. Slots and blocks are joined by index.

What comes to the driver is one row per source; slots, blocks and documents
stay in Spark. Results depend on the data and the seed only.

Edge cases: null text has size 0 and is never taken; a null source is a source
of its own, after all others; a document longer than a block spans several; ties
in doc_id are ordered by size and hash of the text; repeated rows are taken
as rows of their own; sources without words have target 0; an empty table
gives an empty result; other columns pass through `mix`.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, running_starts, ship, shuffle_partitions, text_or_empty, tidy

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Each source's target: shares of sum(sizes) by weight, none above cap times its size."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def draw_shards(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): slots of each source in each shard; columns add up to
    ``quota``. Each row is a multinomial draw with chances by what is lacking,
    drawn on for what a source can't give any more."""
    rng = np.random.default_rng(seed)
    lack = np.array(quota, np.int64)
    total = int(lack.sum())
    out = np.zeros((shards, len(quota)), np.int64)
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        while want:
            got = np.minimum(rng.multinomial(want, lack / lack.sum()), lack)
            out[k] += got
            lack -= got
            want -= int(got.sum())
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: four Feistel rounds
    over the next even number of bits, walked on until the value is below n."""
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in n.tolist()], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            z = right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _plan(docs: DataFrame, block: int, shards: int, cap: float, seed: int, weights):
    """(documents with size, source number and word offset; per-source plan; slot counts)."""
    spark = docs.sparkSession
    ship(spark)
    text = text_or_empty()
    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(text).alias("size"),
                       F.xxhash64(text).alias("h"))
    base = checkpoint(base)
    rows = base.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
    rows.sort(key=lambda r: (r.source is None, r.source or ""))  # by code point, null last
    names, sizes = [r.source for r in rows], [int(r.n or 0) for r in rows]
    goal = targets(sizes, [weights(i, x) for i, x in enumerate(names)], cap)
    blocks = [-(-s // block) for s in sizes]
    quota = [min(int(cap * b), round(g * b / s)) if s else 0 for g, b, s in zip(goal, blocks, sizes)]
    plan = pd.DataFrame({"source": names, "src": range(len(names)), "source_size": sizes, "target": goal, "blocks": blocks})
    plan = spark.createDataFrame(
        [tuple(r) for r in plan.itertuples(index=False)], "source string, src int, source_size long, target double, blocks long")
    drawn = draw_shards(quota, shards, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    k, s = np.nonzero(drawn)
    slots = spark.createDataFrame(
        pd.DataFrame({"shard": k.astype(np.int32), "src": s.astype(np.int32), "first": first[k, s], "n": drawn[k, s],
                      "blocks": np.array(blocks, np.int64)[s] if len(s) else np.empty(0, np.int64)}),
        "shard int, src int, first long, n long, blocks long")
    # as many rows as sources: broadcast by AQE, or joined
    base = base.join(plan, base["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    return base, slots


def weight_by_turn(i: int, _source) -> float:
    return (1.0, 2.0, 3.0)[i % 3]


def mix_slots(slots: DataFrame, seed: int) -> DataFrame:
    """(shard, src, slot, block): the block that each slot of the mix reads."""
    @F.pandas_udf("long")
    def nth(src: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        n, j = blocks.to_numpy(), slot.to_numpy()
        key = (np.uint64(seed) * np.uint64(1_000_003) + src.to_numpy().astype(np.uint64)) * np.uint64(1_000_003) + (j // n).astype(np.uint64)
        return pd.Series(permute(j % n, n, key))

    spread = slots.repartition(shuffle_partitions(slots.sparkSession), "shard", "src")
    each = spread.select("shard", "src", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    return each.select("shard", "src", "slot", nth("src", "slot", "blocks").alias("block"))


def mixed_pieces(docs: DataFrame, block: int = 128, shards: int = 1024, cap: float = 3.0, seed: int = 5,
                 weights=weight_by_turn) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents are (doc_id, source, size, h, source_size,
    target, src, row, first); pieces (row, block, words, times), one for each block
    that a document has words in."""
    base, slots = _plan(docs, block, shards, cap, seed, weights)
    base = base.withColumn("row", F.monotonically_increasing_id())
    base = checkpoint(running_starts(base, ["src"], ["doc_id", "size", "h", "row"], "size", "first"))
    times = mix_slots(slots, seed).groupBy("src", "block").agg(F.count("*").alias("times"))
    last = F.col("first") + F.col("size")
    lo, hi = F.floor(F.col("first") / block), F.floor((last - 1) / block)
    pieces = base.filter("size > 0").select("src", "row", "first", "size", F.explode(F.sequence(lo, hi)).alias("block"))
    words = F.least(last, (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    pieces = pieces.select("src", "row", "block", words.alias("words"))
    return base, pieces.join(times, ["src", "block"], "left").select(
        "row", "block", "words", F.coalesce("times", F.lit(0)).alias("times"))


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    base, pieces = mixed_pieces(docs, **how)
    taken = pieces.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return base.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut_text(text: str, first: int, block: int, times: dict[int, int]) -> list[str]:
    """The texts that a document gives to the mix: the i-th holds the words in
    blocks read more than i times; neighbouring blocks keep the space between."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    out = []
    for i in range(max(times.values(), default=0)):
        parts, end = [], None
        for b in sorted(b for b, t in times.items() if t > i):
            lo, hi = max(0, b * block - first), min(len(spans), (b + 1) * block - first)
            if end is not None and end == lo:
                parts[-1][1] = spans[hi - 1][1]
            else:
                parts.append([spans[lo][0], spans[hi - 1][1]])
            end = hi
        out.append("\n".join(text[s:e] for s, e in parts))
    return out


def mix(docs: DataFrame, block: int = 128, **how) -> DataFrame:
    """The mix as rows of ``docs``' columns: a document that is taken twice gives
    two rows; one taken in part gives the words of the blocks read. n_chars,
    if there, follows the text."""
    base, pieces = mixed_pieces(docs, block=block, **how)
    taken = pieces.filter("times > 0").groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("block", F.col("times").cast("long")))).alias("times"))
    # rows repeated under one id and text are told apart by number; what each takes is interchangeable
    key = Window.partitionBy("doc_id", "h").orderBy("row")
    plan = base.withColumn("nth", F.row_number().over(key)).join(taken, "row").select(
        F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("nth").alias("__n"),
        F.col("first").alias("__first"), F.col("times").alias("__times"))
    whole = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64(text_or_empty()))
    whole = whole.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__hash")))
    j = whole.join(plan, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h")) & (F.col("__nth") == F.col("__n")))

    names = docs.columns

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 256):
                s = b.slice(k, 256)
                texts = [cut_text(t, f, block, dict(m)) for t, f, m in zip(
                    s.column("text").to_pylist(), s.column("__first").to_pylist(), s.column("__times").to_pylist())]
                back = pa.array(list(itertools.chain.from_iterable([i] * len(x) for i, x in enumerate(texts))), pa.int64())
                flat = pa.array([t for x in texts for t in x], pa.string())
                cols = {n: s.column(n).take(back) for n in names if n != "text"}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(t) for x in texts for t in x], pa.int64()).cast(cols["n_chars"].type)
                cols["text"] = flat
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return j.select(*docs.columns, "__first", "__times").mapInArrow(tidy(run), ddl)

