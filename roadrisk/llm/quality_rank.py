"""Quality classifier: Bradley-Terry ranking from preference pairs.

Every text becomes a few counts and shares of its characters, words and lines.
Labelled documents give pairs (label 1 is preferred to label 0); the weights
maximise the pairs' likelihood, a logistic loss on feature differences, so a
document's strength is a weighted sum. The threshold is a quantile of the
training strengths: the share of label 0 among all training rows. A logistic
map sends that strength to the decision value, so that `score >= decision` and
`strength >= threshold` are the same.

Training reads every labelled document that may be learnt from. Their features are
written once and dealt by a hash into blocks of some `per_label` rows of each label;
rows meet their opponents inside a block, each has `pairs` or more, and rows of a
label too rare for all blocks stand in several. Every Newton step adds up what
the blocks' pairs say, and the threshold is an exact quantile over all training
rows: only sums of a few hundred numbers come to the driver. Scoring reads every
text, whole.

Edge cases: null text is empty and has a score like any other (all features
0); documents without a label are scored; labels that are null or not 0 or 1
aren't learnt from; documents with several labels take part with each; with
labels of one kind or none, all strengths are 0 and all scores `decision`
exactly (predicted 1); repeated rows get equal rows; an empty table gives an
empty result; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantile
from .common import bloom_cells, bloom_hit, bloom_size, bloom_words, shared_path, ship, tidy

FEATURES = [
    "log_words", "word_len", "word_len_sd", "long_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs",
    "upper", "all_upper", "digits", "symbols", "stops", "marks_in_a_row", "spaces", "lines_per_word", "distinct_lines",
    "capital_start", "sentence_len", "letters",
]
_MARKS = re.compile(r"[^\w\s.,;:'\-]|[_]")
_ROWS = re.compile(r"[^\w\s]{2,}|_{2,}")


def features(text: str | None) -> list[float]:
    """Features of a whole text, each of order 1."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    size = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text))
    symbols, stops = len(_MARKS.findall(text)), sum(map(text.count, ".,;:!?"))
    digits = sum(map(text.count, "0123456789"))
    ends = sum(map(text.count, ".!?"))
    return [
        np.log1p(n) / 10, size.mean() / 10, min(size.std() / 10, 5.0), float((size > 15).mean()),
        len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        upper / chars, sum(map(str.isupper, words)) / n, digits / chars, symbols / n, stops / n, len(_ROWS.findall(text)) / n,
        (chars - size.sum()) / chars, len(lines) / n, len(set(lines)) / max(1, len(lines)),
        sum(w[0].isupper() for w in words) / n, np.log1p(n / (ends + 1)) / 5, sum(map(str.isalpha, text)) / chars,
    ]


class Ranking(NamedTuple):
    """Strength of a text: ((features - centre) / spread) @ weights; ``threshold`` maps to ``decision``."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    decision: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.strength(x) - self.threshold)
        odds = self.decision / (1 - self.decision) * np.exp(np.clip(z, -500, 500))
        # the decision itself is decided on the strength, not on a rounded logistic
        s = odds / (1 + odds)
        return np.where(z >= 0, np.maximum(s, self.decision), np.minimum(s, np.nextafter(self.decision, 0)))


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """np.quantile of the values, each repeated as often as it weighs (1 or more)."""
    order = np.argsort(values, kind="stable")
    v, upto = values[order], np.cumsum(weights[order])
    at = share * (upto[-1] - 1)
    low, high = v[np.minimum(np.searchsorted(upto, [np.floor(at), np.floor(at) + 1], side="right"), len(v) - 1)]
    return float(low + (at - np.floor(at)) * (high - low))


def _differences(good: np.ndarray, bad: np.ndarray, pairs: int, seed) -> np.ndarray:
    """Each good row less a bad opponent, ``pairs`` for every row of the label that has more."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * pairs
    return good[rng.permutation(n) % len(good)] - bad[rng.permutation(n) % len(bad)]


def _pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, and the sums of gradient and curvature of log(1 + exp(-d w)) over them."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
    return np.concatenate([[len(d)], -(d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _newton(sums: Callable, decay: float, rounds: int) -> np.ndarray:
    """Newton steps on mean log(1 + exp(-d w)) + decay |w|^2 / 2; ``sums`` gives `_pair_sums` at w."""
    k = len(FEATURES)
    w = np.zeros(k)
    for _ in range(rounds):
        total = sums(w)
        n = total[0]
        grad = total[1:k + 1] / n + decay * w
        curve = total[k + 1:].reshape(k, k) / n + decay * np.eye(k)
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = 8, decay: float = 1e-3, rounds: int = 40, decision: float = 0.3,
        seed: int = 3, stand_for: tuple[float, float] = (1.0, 1.0)) -> Ranking:
    """Weights that best explain that each good row is preferred to its bad opponents.

    ``stand_for``: how many training rows a good row and a bad one stand for;
    the threshold is the quantile among all of those."""
    k = len(FEATURES)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0, decision)
    both = np.concatenate([good, bad])
    centre, spread = both.mean(0), both.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    g, b = (good - centre) / spread, (bad - centre) / spread
    d = _differences(g, b, pairs, seed)
    w = _newton(lambda w: _pair_sums(d, w), decay, rounds)
    strength = np.concatenate([g @ w, b @ w])
    weight = np.repeat(np.array(stand_for, np.float64), [len(g), len(b)])
    threshold = weighted_quantile(strength, weight, len(b) * stand_for[1] / weight.sum())
    return Ranking(centre, spread, w, threshold, 1.0, decision)


def held_out(doc_id: str) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_ids(labels: DataFrame) -> DataFrame:
    """(id, quality): all that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")) \
        .filter(F.col("quality").isin(0, 1) & F.col("id").isNotNull()).filter(~held_out("id")).distinct()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, quality, x): features of every labelled document to learn from.

    A Bloom filter of the ids keeps other texts out; only features shuffle for the exact join."""
    ids = training_ids(labels)
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    bits = bloom_size(ids.count())
    words = bloom_words(ids.select(F.explode(F.array(*bloom_cells(F.xxhash64("id"), bits))).alias("cell")))
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    d = bloom_hit(d, F.xxhash64("id"), words, bits, "__hit").filter("__hit").select("id", "text")
    return d.mapInArrow(tidy(run), "id long, x array<double>").join(ids, "id").select("id", "quality", "x")


#: rows of the rarer label that a block holds on average, at least
RARE = 64


def training_blocks(rows: DataFrame, counts: tuple[int, int], per_label: int) -> DataFrame:
    """(block, x0, x1): the features of a block's rows of label 0 and 1, row by row. Every row is in one
    block; rows of a label too rare for RARE in each block are in as many as that takes."""
    n = max(1, math.ceil(max(counts) / per_label))
    copies = [min(n, max(1, math.ceil(RARE * n / c))) for c in counts]
    at = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 0, copies[0] - 1).otherwise(copies[1] - 1)))
    dealt = rows.select("quality", "x", F.xxhash64("id", "x").alias("__h"), at.alias("__copy")) \
        .select(F.pmod(F.col("__h") + F.col("__copy"), F.lit(n)).cast("int").alias("block"), "quality", "x")
    width = len(FEATURES)

    def gather(t: pa.Table) -> pa.Table:
        x = np.array(t.column("x").combine_chunks().flatten()).reshape(-1, width)
        q = np.array(t.column("quality"))
        # in an order of their own, however the rows were dealt
        x0, x1 = (y[np.lexsort(y.T[::-1])].ravel() for y in (x[q == 0], x[q == 1]))
        return pa.table({"block": t.column("block").slice(0, 1), "x0": pa.array([x0], pa.list_(pa.float64())), "x1": pa.array([x1], pa.list_(pa.float64()))})

    return dealt.groupBy("block").applyInArrow(gather, "block int, x0 array<double>, x1 array<double>")


def _added(vectors: DataFrame) -> np.ndarray:
    """Sum of the arrays in column v, place by place; decimals, so that the order of the rows doesn't matter."""
    one = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(28,14)")).alias("x"))
    return np.array([float(r.x) for r in sorted(one.collect(), key=lambda r: r.i)])


def train(docs: DataFrame, labels: DataFrame, per_label: int = 10_000, decision: float = 0.3, pairs: int = 8, decay: float = 1e-3,
          rounds: int = 40, seed: int = 3) -> Ranking:
    """`fit` on all rows to learn from, whose pairs meet in blocks of some ``per_label`` rows of each label."""
    spark, k = docs.sparkSession, len(FEATURES)
    path = shared_path(spark, "quality-training")
    training_rows(docs, labels).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    found = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}  # two rows
    counts = found.get(0, 0), found.get(1, 0)
    if not min(counts):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0, decision)
    centre = _added(rows.select(F.col("x").alias("v"))) / sum(counts)
    apart = F.transform(F.arrays_zip(F.col("x").alias("x"), F.lit(centre.tolist()).alias("c")), lambda z: (z["x"] - z["c"]) * (z["x"] - z["c"]))
    spread = np.sqrt(_added(rows.select(apart.alias("v"))) / sum(counts))
    spread = np.where(spread > 1e-9, spread, 1.0)
    training_blocks(rows, counts, per_label).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")

    def sums(w):
        def run(batches):
            for b in batches:
                for r in range(len(b)):
                    x0, x1 = (np.array(b.column(c)[r].values).reshape(-1, k) / spread for c in ("x0", "x1"))
                    if len(x0) and len(x1):
                        block = b.column("block")[r].as_py()
                        v = _pair_sums(_differences(x1, x0, pairs, [seed, block] if block else seed), w)
                        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64()))], names=["v"])

        return _added(blocks.mapInArrow(tidy(run), "v array<double>"))

    w = _newton(sums, decay, rounds)
    ranking = Ranking(centre, spread, w, 0.0, 1.0, decision)

    def strength(batches):
        for b in batches:
            x = np.array(b.column("x").flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(ranking.strength(x))], names=["strength"])

    strengths = rows.select("x").mapInArrow(tidy(strength), "strength double")
    threshold = exact_quantile(strengths, "strength", counts[0] / sum(counts)).first()["quantile"]
    return ranking._replace(threshold=float(threshold))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 if score >= decision)."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(ranking)  # a few numbers per feature
    where = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(where)]).reshape(-1, len(FEATURES))
            s = model.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array((s >= model.value.decision).astype(np.int32))],
                names=[*b.schema.names, "score", "predicted"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{ddl}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    ranking = train(docs, labels)
    return score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ranking).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least the decision value.

    The model's columns are named apart, so columns called score or predicted pass through."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else n) for c, n in zip(docs.columns, names)])
    kept = score(plain, train(docs, labels)).filter("predicted = 1")
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, names)])

