"""Embedding near-dedup by sorted projection passes.

A pass gives every vector a code, the signs of its products with random
directions, orders the vectors of a label lexicographically by code and
compares each with its neighbours in a bounded window. Passes with other
directions bring other neighbours together; what they verify is united. The
window goes by the place in the label's whole order: blocks of places get the
window before them along, so neither partitions nor blocks cut it.

A dense group would need every pair of its members, more than a window holds.
So the first passes gather classes: a vector within half the link angle of a
leader joins it. Any two members of a class are then linked for certain
(triangle inequality), so a class counts as one point with a radius, its
size-1 inner links need no pairs, and windows compare leaders only. Two
classes whose leaders are near enough to hold a linked pair are compared
member by member in blocks of bounded size; only counts leave a block.

Codes of a label are taken from its mean, so that leaders crowded round one
direction spread as well. Two leaders meet for certain in a pass if their codes
share the first log2(leaders / window) bits, each of which they share with
probability 1 - angle / pi, the angle seen from the mean. So a label with more
leaders gets more passes, as many as bring a pair at the link angle together
with probability ``recall``; a label that fits one window gets one, which
compares all its pairs.

The formula knows one crowd, not several. So after each round every label
counts the near pairs that one pass and that two passes found; from these
follows how many no pass found (Chao's estimate for repeated samples). A label
whose share found is below ``recall`` gets twice the passes, until it is reached
or the windows of its passes would add up to the label itself: then its window
grows to the whole label, compared in pairs of blocks, and nothing is missed.

Cosines are computed in double precision. Links reported are verified; links
missed are those whose classes never meet in a window (tests measure recall
against brute force, crowded labels too).

Edge cases: a vector that is null, empty, zero or has a null or non-finite
component, or whose label is null, links with nothing (n_links 0, its own
component); vectors of other lengths never link; repeated rows and ties are
links like any other; repeated vec_ids are separate vectors with the smallest
id of their component; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .common import attach_group_stats, checkpoint, connected_components, running_starts, ship, shuffle_partitions

#: slack of the angle bounds, far above double rounding
SLACK = 1e-9
BLOCK = 256


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _code(unit: np.ndarray, seed: int, bits: int) -> list[bytes]:
    directions = np.random.default_rng(seed).standard_normal((unit.shape[1], bits))
    return [b.tobytes() for b in np.packbits(unit @ directions > 0, axis=1)]


def _sorted_pass(vectors: DataFrame, seed: int, bits: int) -> DataFrame:
    """Rows of one label and length, near in code order, in one sorted partition.

    The row number ends the key: copies with the same code may be split."""
    def run(frames):
        for f in frames:
            f["code"] = b""
            for _, part in f.groupby("dim"):
                f.loc[part.index, "code"] = pd.Series(_code(_unit(part["embedding"]), seed, bits), index=part.index)
            yield f

    coded = vectors.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", code binary")
    n = shuffle_partitions(vectors.sparkSession)
    key = ["label", "dim", "code", "row"]
    return coded.repartitionByRange(n, *key).sortWithinPartitions(*key)


def _runs(frames, rows: int, keys=("label", "dim")):
    """Sorted frames cut into pieces of equal ``keys`` and at most ``rows`` rows."""
    keys = list(keys)
    for f in frames:
        if len(f):
            new = f[keys].ne(f[keys].shift()).any(axis=1).cumsum()
            for _, part in f.groupby(new, sort=False):
                for k in range(0, len(part), rows):
                    yield part.iloc[k:k + rows]


def gather_classes(vectors: DataFrame, cosine: float, seed: int, bits: int, window: int) -> DataFrame:
    """(row, leader, near): each vector's leader within half the link angle, and
    its cosine with it; vectors with none near in the window lead themselves."""
    half = math.cos(math.acos(cosine) / 2 - SLACK)

    def run(frames):
        key, lead, lead_row = None, None, None
        for part in _runs(frames, BLOCK):
            here = (part["label"].iat[0], part["dim"].iat[0])
            x, rows = _unit(part["embedding"]), part["row"].to_numpy()
            if here != key:
                key, lead, lead_row = here, np.empty((0, x.shape[1])), np.empty(0, np.int64)
            leader, near = rows.copy(), np.ones(len(rows))
            free = np.ones(len(rows), bool)
            if len(lead):
                s = x @ lead.T
                j = s.argmax(1)
                top = s[np.arange(len(x)), j]
                free = top < half
                leader[~free], near[~free] = lead_row[j[~free]], top[~free]
            s = x @ x.T
            for i in np.flatnonzero(free & ((s >= half) & free).sum(1).astype(bool)):
                if free[i]:
                    own = free & (s[i] >= half)
                    own[i] = False
                    leader[own], near[own] = rows[i], s[i][own]
                    free[own] = False  # i itself stays a leader
            new = np.flatnonzero(leader == rows)
            lead = np.concatenate([lead, x[new]])[-window:]
            lead_row = np.concatenate([lead_row, rows[new]])[-window:]
            yield pd.DataFrame({"row": rows, "leader": leader, "near": near})

    return _sorted_pass(vectors, seed, bits).mapInPandas(run, "row long, leader long, near double")


def passes_needed(n: Column, radius: Column, crowd: Column, cosine: float, window: int, least: int, recall: float) -> Column:
    """Passes after which two linked members' leaders have met with probability
    ``recall``, for ``n`` leaders of classes of at most ``radius``, whose members
    lie off their leaders in unrelated directions. ``crowd`` is the squared
    length of the leaders' mean: the mean cosine of two of them."""
    seen = (F.lit(cosine) * F.cos(radius) * F.cos(radius) - crowd) / F.greatest(1 - crowd, F.lit(1e-9))
    meet = F.pow(1 - F.acos(F.greatest(F.lit(-0.9), F.least(seen, F.lit(1.0)))) / math.pi, F.log2(n / window))
    more = F.ceil(F.least(F.lit(1e9), math.log(1 - recall) / F.log1p(-F.least(meet, F.lit(1 - 1e-9))))).cast("int")
    return F.when(n <= window, F.lit(1)).otherwise(F.greatest(F.lit(least), more))


GROUP = ["label", "dim"]


def centres(leaders: DataFrame) -> DataFrame:
    """(label, dim, centre): the mean of a label's unit vectors."""
    def run(frames):
        for f in frames:
            for (label, dim), part in f.groupby(GROUP):
                x = _unit(part["embedding"])
                yield pd.DataFrame({"label": label, "dim": dim, "at": np.arange(dim), "s": x.sum(0), "k": len(x)})

    label = leaders.schema["label"].dataType.simpleString()
    sums = leaders.select(*GROUP, "embedding").mapInPandas(run, f"label {label}, dim int, at int, s double, k long")
    mean = sums.groupBy(*GROUP, "at").agg((F.sum("s") / F.sum("k")).alias("m"))
    return mean.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda e: e["m"]).alias("centre"))


def code_places(leaders: DataFrame, seed: int, bits: int) -> DataFrame:
    """(pass, label, dim, row, n, place): each leader's place, from 0, in the code
    order of its label and length, for passes ``lo`` to before ``hi``."""
    def run(frames):
        for f in frames:
            for _, part in f.groupby(GROUP):
                x, centre = _unit(part["embedding"]), part["centre"].iat[0]
                if centre is not None:
                    x = x - np.asarray(centre)
                for k in range(part["lo"].iat[0], part["hi"].iat[0]):
                    yield part[["label", "dim", "row", "n"]].assign(code=_code(x, seed + k, bits)).assign(**{"pass": k})

    label = leaders.schema["label"].dataType.simpleString()
    coded = leaders.select(*GROUP, "row", "n", "lo", "hi", "centre", "embedding").mapInPandas(
        run, f"label {label}, dim int, row long, n long, code binary, pass int")
    # the row number ends the order: copies with the same code may be parted
    return running_starts(coded.withColumn("one", F.lit(1)), ["pass", *GROUP], ["code", "row"], "one", "place") \
        .select("pass", *GROUP, "row", "n", "place")


def _compared(dealt: DataFrame, key: list[str], order: list[str], cosine: float, window: int) -> DataFrame:
    """(label, dim, a, b, c, likely) with a < b: leaders of equal ``key``, near enough
    for their classes to hold a linked pair, c their cosine. A row that is ``own``
    is compared with the last ``window`` rows before it that are ``held``."""
    link = math.acos(cosine) + SLACK

    def run(frames):
        last = old = old_row = old_r = None
        for part in _runs(frames, BLOCK, key):
            here = tuple(part[k].iat[0] for k in key)
            x, rows, r = _unit(part["embedding"]), part["row"].to_numpy(), part["radius"].to_numpy()
            own, held = part["own"].to_numpy(), part["held"].to_numpy()
            if here != last:
                last, old, old_row, old_r = here, np.empty((0, x.shape[1])), np.empty(0, np.int64), np.empty(0)
            both, both_row, both_r = np.concatenate([old, x]), np.concatenate([old_row, rows]), np.concatenate([old_r, r])
            if own.any():
                s = x @ both.T
                limit = np.cos(np.minimum(math.pi, link + r[:, None] + both_r[None, :]))
                before = np.arange(len(both))[None, :] < len(old) + np.arange(len(x))[:, None]
                stays = np.concatenate([np.ones(len(old), bool), held])
                i, j = np.nonzero((s >= limit) & own[:, None] & before & stays[None, :])
                yield pd.DataFrame({
                    "label": part["label"].iat[0], "dim": part["dim"].iat[0], "a": np.minimum(rows[i], both_row[j]),
                    "b": np.maximum(rows[i], both_row[j]), "c": s[i, j],
                    "likely": s[i, j] >= cosine * np.cos(r[i]) * np.cos(both_r[j])})
            if held.any():
                stays = np.concatenate([np.ones(len(old), bool), held])
                old, old_row, old_r = both[stays][-window:], both_row[stays][-window:], both_r[stays][-window:]

    label = dealt.schema["label"].dataType.simpleString()
    return dealt.repartition(shuffle_partitions(dealt.sparkSession), *key).sortWithinPartitions(*key, *order) \
        .mapInPandas(run, f"label {label}, dim int, a long, b long, c double, likely boolean")


def near_in_windows(leaders: DataFrame, cosine: float, seed: int, bits: int, window: int) -> DataFrame:
    """Near leaders (see ``_compared``), once for each pass whose window they share.
    Blocks of two windows of places get the window before them along."""
    cut = 2 * window
    block = F.floor(F.col("place") / cut).cast("long")
    along = (F.col("place") % cut >= cut - window) & ((block + 1) * cut < F.col("n"))
    dealt = code_places(leaders, seed, bits).select(
        "pass", *GROUP, "row", "place", F.explode(F.when(along, F.array(block, block + 1)).otherwise(F.array(block))).alias("block")) \
        .withColumn("own", F.col("block") == block).withColumn("held", F.lit(True))
    return _compared(dealt.join(leaders.select("row", "embedding", "radius"), "row"),
                     ["pass", *GROUP, "block"], ["place"], cosine, window)


def near_in_label(leaders: DataFrame, cosine: float, rows: int) -> DataFrame:
    """Near leaders (see ``_compared``) of whole labels: blocks of some ``rows`` rows by
    row hash, every two of which meet in one piece of work of bounded size."""
    last = F.floor((F.col("n") - 1) / rows).cast("long")
    block = F.pmod(F.xxhash64("row"), last + 1)
    dealt = leaders.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))) \
        .select(*GROUP, "row", "embedding", "radius", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")) \
        .withColumn("own", F.col("block") == F.col("j")).withColumn("held", F.col("block") == F.col("i"))
    return _compared(dealt, [*GROUP, "i", "j"], ["block", "row"], cosine, 1 << 62)


def near_classes(leaders: DataFrame, cosine: float, seed: int, bits: int, window: int, passes: int, recall: float) -> DataFrame:
    """(a, b, c) with a < b: leaders that met, near enough for their classes to
    hold a linked pair, c their cosine. Rounds of passes, as the module's head says;
    what a round decides is one row per label."""
    leaders = checkpoint(attach_group_stats(
        leaders, GROUP, {"n": (F.count("*"), F.sum), "most": (F.max("radius"), F.max)}, ["row"]).filter("n > 1"))
    labels = leaders.groupBy(*GROUP).agg(F.max("n").alias("n"), F.max("most").alias("most"))
    labels = labels.join(centres(leaders.filter(F.col("n") > window)), GROUP, "left")
    crowd = F.coalesce(F.aggregate("centre", F.lit(0.0), lambda s, e: s + e * e), F.lit(0.0))

    def all_of(hi):  # windows of so many passes compare as much as the whole label
        return hi * F.lit(2.0 * window) >= F.col("n")

    hi = passes_needed(F.col("n"), F.col("most"), crowd, cosine, window, passes, recall)
    todo = checkpoint(labels.withColumn("lo", F.lit(0)).withColumn("hi", hi).select(
        *GROUP, "n", "centre", "lo", "hi", ((F.col("hi") > F.greatest(F.lit(1), F.lit(passes))) & all_of(F.col("hi"))).alias("all")))
    found = None
    while True:
        now = leaders.select(*GROUP, "row", "embedding", "radius").join(broadcast_if_small(todo), GROUP)
        met = near_in_windows(now.filter("NOT all"), cosine, seed, bits, window).unionByName(
            near_in_label(now.filter("all"), cosine, 8 * window)).withColumn("times", F.lit(1).cast("long"))
        met = met if found is None else met.unionByName(found)
        found = checkpoint(met.groupBy(*GROUP, "a", "b").agg(
            F.max("c").alias("c"), F.max("likely").alias("likely"), F.sum("times").alias("times")))
        counts = found.filter("likely").groupBy(*GROUP).agg(
            F.count("*").cast("double").alias("s"), F.count_if(F.col("times") == 1).cast("double").alias("once"),
            F.count_if(F.col("times") == 2).cast("double").alias("twice"))
        missed = (1 - 1 / F.col("hi")) * F.col("once") * (F.col("once") - 1) / (2 * (F.col("twice") + 1))
        twice = 2 * F.col("hi")
        todo = checkpoint(todo.filter(~F.col("all") & (F.col("n") > window)).join(counts, GROUP)
                          .filter(missed > (1 - recall) * (F.col("s") + missed))
                          .select(*GROUP, "n", "centre", F.col("hi").alias("lo"), twice.alias("hi"), all_of(twice).alias("all")))
        if todo.isEmpty():
            return found.select("a", "b", "c")


def compare_members(pairs: DataFrame, members: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, row, n) for class pairs that may hold links: how many members of
    the other class each member links with. Members are dealt in blocks by row
    hash, so a block pair is bounded; only counts leave it."""
    cut = members.join(classes.select(F.col("leader"), "size"), "leader").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK).cast("long")))
    blocks = cut.groupBy("leader", "block").agg(F.collect_list(F.struct("row", "embedding")).alias("m"))

    def run(frames):
        for f in frames:
            for a, b, ma, mb in zip(f["a"], f["b"], f["ma"], f["mb"]):
                hit = _unit([m["embedding"] for m in ma]) @ _unit([m["embedding"] for m in mb]).T >= cosine
                rows = [m["row"] for m in ma] + [m["row"] for m in mb]
                n = np.concatenate([hit.sum(1), hit.sum(0)])
                out = pd.DataFrame({"a": a, "b": b, "row": rows, "n": n})
                yield out[out["n"] > 0]

    side = lambda x: blocks.select(F.col("leader").alias(x), F.col("m").alias(f"m{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb") \
        .mapInPandas(run, "a long, b long, row long, n long")


def near_duplicate_vectors(df: DataFrame, cosine: float = 0.93, passes: int = 8, window: int = 512, bits: int = 64,
                           seed: int = 7, recall: float = 0.97) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``.

    ``passes`` is the least number for a label that doesn't fit one window."""
    ship(df.sparkSession)
    e = F.col("embedding").cast("array<double>")
    # finite: a value less itself is 0, for NaN and infinities it isn't
    fine = (F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
            & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(e, lambda x: x != 0))
    base = checkpoint(df.select(
        F.col("vec_id").cast("long"), "label", e.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"),
        F.monotonically_increasing_id().alias("row")))
    # scaled by the largest component: squares neither overflow nor vanish
    big = F.array_max(F.transform("embedding", F.abs))
    vectors = base.filter("fine").select(
        "row", "label", F.size("embedding").alias("dim"),
        F.transform("embedding", lambda x: x / big).alias("embedding"))
    member = checkpoint(gather_classes(vectors, cosine, seed, bits, window))
    classes = checkpoint(member.groupBy("leader").agg(
        F.count("*").alias("size"), F.acos(F.least(F.lit(1.0), F.min("near"))).alias("radius")))
    leaders = vectors.join(classes, F.col("row") == F.col("leader")).select(*vectors.columns, "radius")
    met = near_classes(leaders, cosine, seed + 1, bits, window, passes, recall)
    of = classes.select(F.col("leader"), F.col("size"), F.col("radius"))
    met = met \
        .join(of.toDF("a", "na", "ra"), "a").join(of.toDF("b", "nb", "rb"), "b")
    met = checkpoint(met.withColumn("sure", F.when((F.col("na") == 1) & (F.col("nb") == 1), F.col("c") >= cosine).otherwise(
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c")))) + F.col("ra") + F.col("rb")
        <= math.acos(cosine) - SLACK)))
    open_pairs = met.filter("NOT sure AND na + nb > 2")
    sure = met.filter("sure")
    whole = vectors.select("row", "embedding").join(member.select("row", "leader"), "row")
    wanted = open_pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    counted = checkpoint(compare_members(open_pairs, whole.join(wanted, "leader", "left_semi"), classes, cosine))
    found = connected_components(sure.select("a", "b").unionByName(counted.select("a", "b").distinct()))
    to_class = sure.select(F.col("a").alias("leader"), F.col("nb").alias("n")).unionByName(
        sure.select(F.col("b").alias("leader"), F.col("na").alias("n"))).groupBy("leader").agg(F.sum("n").alias("class_links"))
    to_row = counted.groupBy("row").agg(F.sum("n").alias("row_links"))
    root = F.coalesce("root", "leader")
    per_class = checkpoint(classes.join(found, F.col("leader") == F.col("node"), "left").join(to_class, "leader", "left").select(
        "leader", root.alias("root"), (F.col("size") - 1 + F.coalesce("class_links", F.lit(0))).alias("inner")))
    rows = base.join(member.select("row", "leader"), "row", "left") \
        .withColumn("leader", F.coalesce("leader", "row")).select("vec_id", "row", "leader")
    low = attach_group_stats(rows, ["leader"], {"low": (F.min("vec_id"), F.min)}, ["row"], lookup=per_class)
    low = low.withColumn("root", root)
    low = attach_group_stats(low, ["root"], {"component_id": (F.min("low"), F.min)}, ["row"])
    return low.join(to_row, "row", "left").select(
        "vec_id", (F.coalesce("inner", F.lit(0)) + F.coalesce("row_links", F.lit(0))).cast("long").alias("n_links"),
        "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
