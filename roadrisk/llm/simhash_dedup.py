"""SimHash near-dedup by the general pigeonhole principle.

1. Fingerprint: 64-bit SimHash over word shingles (XXH64, seed 42), numpy in
   `mapInArrow`.
2. Equal fingerprints are one node; documents join it again at the end with
   hot nodes split by salt.
3. Bits are grouped into partitions by their correlation over all nodes, so
   that the partitions are as independent as can be. With thresholds t_i that
   add up to (distance - partitions + 1), any two fingerprints within
   `distance` differ in at most t_i bits in some partition i (t_i = -1: not
   probed). Number of partitions and thresholds come from a dynamic programme
   over estimated cost: probes sent plus candidates met, the latter from the
   partition's squared value counts over all nodes.
4. Every node is filed under its value in each probed partition and probes all
   values within t_i there. First a probe meets one representative of each
   bucket, the node of the most rows; components of these verified links settle
   most of a crowded group at one row a probe. Then a probe meets the members of
   buckets that hold a larger component than its own, and what is listed are the
   different components of pairs within `distance`. A pair not listed is
   connected already, so no component is split.
5. Components by alternating stars: of the first links, then of the components
   that the second links join.

Edge cases: null text is empty; a text without words has fingerprint zero and
links like any other; a text with fewer words than a shingle is one shingle;
repeated rows get equal rows; null doc_ids lose to all others and are their
own component only if nothing else is reachable (component_id null); empty
table, empty result; other columns don't matter.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_group_stats, checkpoint, connected_components, drop_listed, ship, text_or_empty, tidy

SEED = 42
#: set bits of each byte value, lowest first
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: str | None, words_in_shingle: int) -> int:
    """Fingerprint of one text, as a signed 64-bit integer."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < words_in_shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        view = memoryview(whole)
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - words_in_shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(view[s:e - 1], SEED) for s, e in zip(starts, ends[words_in_shingle - 1:])]
    by_byte = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, columns to carry), one row per row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([simhash(t.as_py(), words_in_shingle) for t in texts], pa.int64()),
                 *[b.column(c) for c in carry]],
                names=["doc_id", "fp", *carry])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry)
    return d.mapInArrow(tidy(run), "doc_id long, fp long" + "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in carry))


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, per-bit sums and 64 x 64 co-occurrence sums over all fingerprints."""
    def run(batches):
        n, ones, both = 0, np.zeros(64), np.zeros((64, 64))
        for b in batches:
            v = b.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            n, ones = n + len(bits), ones + bits.sum(0, dtype=np.float64)
            for k in range(0, len(bits), 4096):
                both += bits[k:k + 4096].T @ bits[k:k + 4096]
        cells = np.concatenate([[n], ones, both.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "x"])

    got = np.zeros(1 + 64 + 64 * 64)
    for r in nodes.select("fp").mapInArrow(tidy(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        got[r.i] = r.x
    return int(got[0]), got[1:65], got[65:].reshape(64, 64)


def group_bits(n: int, ones: np.ndarray, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into ``parts`` groups of like size; each group starts at
    the free bit that correlates most and takes in the free bits nearest to it."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: corr[b, left].sum())]
        free.discard(group[0])
        while len(group) < width:
            group.append(max(sorted(free), key=lambda b: corr[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, bits: list[int], radius: int) -> float:
    """Chance that two fingerprints differ in at most ``radius`` of ``bits``, bits taken as independent."""
    at = np.zeros(len(bits) + 1)
    at[0] = 1
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        at[1:] = at[1:] * (1 - d) + at[:-1] * d
        at[0] *= 1 - d
    return float(at[: radius + 1].sum())


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and least cost; cost[i][t] for t = -1, 0, 1, ..."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in options.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total]


def mask_of(bits) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def plan_partitions(nodes: DataFrame, distance: int, max_parts: int = 6, probe_cost: float = 8.0):
    """[(bits, threshold)] of the probed partitions. ``probe_cost``: cost of one
    probe row sent, in candidate pairs met."""
    n, ones, both = bit_moments(nodes)
    p = ones / max(n, 1)
    tried = {m: group_bits(n, ones, both, m) for m in range(1, min(max_parts, distance + 1) + 1)}
    masks = [(m, i, bits) for m, groups in tried.items() for i, bits in enumerate(groups)]
    values = nodes.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("v"))
        for k, (_, _, bits) in enumerate(masks)])).alias("s")).select("s.*")
    met = values.groupBy("k", "v").agg(F.count("*").cast("double").alias("c")).groupBy("k").agg(
        F.sum(F.col("c") * F.col("c")).alias("pairs"))
    pairs = {(masks[r.k][0], masks[r.k][1]): r.pairs for r in met.collect()}
    plans = []
    for m, groups in tried.items():
        total = distance - m + 1
        cost = []
        for i, bits in enumerate(groups):
            options = {-1: 0.0}
            for t in range(min(total + m - 1, 3, len(bits)) + 1):
                probes = sum(math.comb(len(bits), r) for r in range(t + 1))
                candidates = pairs.get((m, i), 0) * within(p, bits, t) / max(within(p, bits, 0), 1e-300)
                options[t] = n * probes * probe_cost + candidates
            cost.append(options)
        with_sum = None
        try:
            with_sum = allocate(cost, total)
        except KeyError:
            pass  # this many partitions can't share out so much
        if with_sum:
            plans.append((with_sum[0], [(g, t) for g, t in zip(groups, with_sum[1]) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def keyed(nodes: DataFrame, plan, around: bool) -> DataFrame:
    """(columns of ``nodes``, k, v): each node under its value in every probed
    partition, and with ``around`` under all values within the threshold."""
    out = []
    for k, (bits, t) in enumerate(plan):
        flips = [mask_of(x) for r in range(t + 1 if around else 1) for x in itertools.combinations(bits, r)]
        value = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        out.append(nodes.select(
            *nodes.columns, F.lit(k).alias("k"),
            (F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: value.bitwiseXOR(x)))
             if len(flips) > 1 else value).alias("v")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def near_by(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def first_links(nodes: DataFrame, plan, distance: int) -> DataFrame:
    """Distinct (a, b): nodes (fp, n) within ``distance`` of a bucket's representative."""
    heads = keyed(nodes, plan, False).groupBy("k", "v").agg(F.max(F.struct("n", "fp"))["fp"].alias("b"))
    return keyed(nodes.select(F.col("fp")), plan, True).join(heads, ["k", "v"]) \
        .filter((F.col("fp") != F.col("b")) & near_by("fp", "b", distance)) \
        .select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()


def second_links(nodes: DataFrame, plan, distance: int) -> DataFrame:
    """Distinct (a, b): the roots of all pairs of nodes (fp, root, size) within
    ``distance`` whose roots differ.

    Either node of a pair probes the bucket that holds the other, so the one of the smaller
    component is enough: it probes buckets that hold a larger one. A crowd of one
    component never meets itself, and an outlier in its bucket meets it once."""
    rank, rank2 = F.struct("size", "root"), F.struct("size2", "root2")
    filed = keyed(nodes, plan, False)
    largest = filed.groupBy("k", "v").agg(F.max(rank).alias("most"))
    probes = keyed(nodes, plan, True).join(largest, ["k", "v"]).filter(rank < F.col("most")).drop("most")
    other = filed.withColumnsRenamed({"fp": "fp2", "root": "root2", "size": "size2"})
    return probes.join(other, ["k", "v"]).filter((rank < rank2) & near_by("fp", "fp2", distance)) \
        .select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct()


def links(nodes: DataFrame, plan, distance: int) -> DataFrame:
    """Distinct (a, b), a < b, of all fingerprints within ``distance``, one row per pair: for
    callers who want the pairs themselves; components take ``near_roots``."""
    nodes = nodes.select("fp")
    other = keyed(nodes, plan, False).withColumnRenamed("fp", "b")
    return keyed(nodes, plan, True).withColumnRenamed("fp", "a").join(other, ["k", "v"]) \
        .filter((F.col("a") < F.col("b")) & near_by("a", "b", distance)).select("a", "b").distinct()


def near_roots(nodes: DataFrame, plan, distance: int) -> DataFrame:
    """(fp, root) of every node (fp, n): root is one fingerprint of its component."""
    settled = connected_components(first_links(nodes, plan, distance)).withColumnRenamed("node", "fp")
    rooted = nodes.join(settled, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # very many nodes may have one root: they are split
    size = {"size": (F.count("*"), F.sum)}
    rooted = checkpoint(attach_group_stats(rooted, ["root"], size, ["fp"]))
    joined = connected_components(second_links(rooted, plan, distance)).withColumnsRenamed({"root": "top", "node": "root"})
    return attach_group_stats(rooted.drop("size"), ["root"], size, ["fp"], lookup=joined) \
        .select("fp", F.coalesce("top", "root").alias("root"))


def component_lows(f: DataFrame, value: Column, distance: int) -> DataFrame:
    """``f``, rows with a fingerprint, plus low: the smallest ``value`` of the row's component."""
    nodes = checkpoint(f.groupBy("fp").agg(F.min(value).alias("low"), F.count("*").alias("n")))
    roots = near_roots(nodes.select("fp", "n"), plan_partitions(nodes, distance), distance)
    low = checkpoint(roots.join(nodes, "fp").select(F.col("fp").alias("node"), "root", "low"))
    # a component's smallest value, back on each of its nodes
    low = attach_group_stats(low, ["root"], {"whole": (F.min("low"), F.min)}, ["node"]) \
        .select(F.col("node").alias("fp"), "whole")
    own = attach_group_stats(f, ["fp"], {"low": (F.min(value), F.min)}, ["doc_id"], lookup=low)
    return own.select(*f.columns, F.coalesce("whole", "low").alias("low"))


def near_duplicate_components(docs: DataFrame, words_in_shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id), one row per row of ``docs``."""
    f = checkpoint(fingerprints(docs, words_in_shingle))
    return component_lows(f, F.col("doc_id"), distance).withColumnRenamed("low", "component_id")


def near_dedup(docs: DataFrame, words_in_shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that are the first of their component by doc_id,
    fingerprint and text: rows of one id are decided each by its own text.

    Rows with a null doc_id stay, and so do rows equal in id and text to one
    that stays (exact dedup leaves one of them). Only rows that a Bloom filter
    of the dropped ones lets through shuffle."""
    digest = F.unhex(F.sha2(F.concat(F.col("doc_id").cast("long").cast("string"), F.lit(":"), text_or_empty()), 256))
    whole = docs.withColumn("__key", digest)  # null for a null id
    f = checkpoint(fingerprints(whole, words_in_shingle, ("__key",)))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "fp", "__key"))
    dropped = checkpoint(component_lows(f, own, distance).filter(own != F.col("low")).select("__key"))
    return drop_listed(whole, dropped, "__key").select(*docs.columns)
