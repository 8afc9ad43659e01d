"""Removal of long repeated byte strings by prefix-free parsing.

Every byte covered by a string of ``length`` bytes that also starts anywhere else
goes. Texts are parsed where a hash of the rolling eight-byte gram is least
within `radius` grams on both sides (a trigger depends on the bytes around it
alone, so equal strings are parsed alike). A phrase is the run of start positions
up to its trigger, at most `reach` of them; a start belongs to the first trigger
after it, and is told by its phrase's suffix from it on (the dictionary) and what
follows the trigger (the parse).

1. Per trigger one row of hashes: of the first bytes that follow, which all
   starts of the phrase have in common (its key), and of the phrase with all that
   may follow (its class). Triggers with a key of their own hold no repeated start.
2. A class that occurs twice or more repeats as a whole: no text is looked at.
3. Of the other classes that share a key, one occurrence each goes, with its bytes,
   to its key's share. There the dictionary's phrases are sorted from
   their end (their suffix array: phrases with a common suffix stand together),
   what follows is sorted too (the parse's suffix array), both with the common
   lengths of neighbours; for each distance from the trigger the two orders give
   the starts' corpus order, and starts that fall together in it are repeated.
   A key that more than `hot` classes share is spread instead: its starts meet by
   the hash of their whole string.
4. Starts without a trigger within reach (periodic text, say) meet by the hash of
   their string from the beginning. A document lists each such string once, with how
   often it holds it, and the starts of those that it holds twice or more.

Documents without repeated starts pass straight on; only others, found by a Bloom
filter of bounded size, are joined with their spans.

Edge cases: null text is empty; texts shorter than ``length`` bytes keep all;
occurrences may overlap, in one document too; rows that repeat as a whole remove each
other's bytes; null ids are ids. Spans are judged on the input. An empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group_stats, bloom_cells, bloom_hit, bloom_size, bloom_words, shared_path, ship, text_or_empty, tidy

#: bytes of a gram
GRAM = 8
#: writer options of what is kept between the steps: a phrase's bytes overlap with its neighbours'
SMALL = {"compression": "zstd"}


@dataclass(frozen=True)
class Shape:
    """What follows from the length of a repeated string."""
    length: int = 400

    def __post_init__(self):
        if self.length < 2 * GRAM + 8:
            raise ValueError("repeated strings must have 24 bytes at least")

    @property
    def radius(self) -> int:
        """Grams on each side that a trigger is least among."""
        return max(1, self.length // 10)

    @property
    def reach(self) -> int:
        """Starts that one trigger can tell; it lies in their string with all it depends on."""
        return self.length - max(self.length // 4, 2 * self.radius + GRAM)


def triggers(data: np.ndarray, radius: int) -> np.ndarray:
    """Where the surroundings of a trigger begin: its gram is ``radius`` further on."""
    n = len(data) - GRAM + 1
    if n < 2 * radius + 1:
        return np.empty(0, np.int64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    gram = four[:-4] | four[4:] << np.uint64(32)
    gram = (gram ^ gram >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    h = (gram >> np.uint64(32)).astype(np.uint32)
    least, width = h, 1
    while 2 * width <= radius:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < radius:
        least = np.minimum(least[:len(least) - (radius - width)], least[radius - width:])
    # least[i]: of the grams i .. i + radius - 1
    mid = h[radius:n - radius]
    return np.flatnonzero((mid < least[:len(mid)]) & (mid <= least[radius + 1:radius + 1 + len(mid)]))


def _phrases(data: bytes, sizes: np.ndarray, shape: Shape):
    """(document, place, starts) of every trigger that tells starts, and of every start that no
    trigger tells (those have 0 in ``starts``); places are in ``data``, the joined texts."""
    begins = np.cumsum(sizes) - sizes
    t = triggers(np.frombuffer(data, np.uint8), shape.radius)
    doc = np.searchsorted(begins, t, side="right") - 1
    # the last of the documents that begin at a place is the one that isn't empty
    keep = t + 2 * shape.radius + GRAM <= begins[doc] + sizes[doc]
    t, doc = t[keep], doc[keep]
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(t) else np.empty(0, bool)
    before = np.where(new, begins[doc] - 1, np.concatenate([[0], t[:-1]]) if len(t) else t)
    last = begins + sizes - shape.length  # the last start of each document
    low = np.maximum(before + 1, t - shape.reach + 1)
    tells = low <= last[doc]
    out = [np.stack([doc, t, t - low + 1], 1)[tells]]
    # starts too far before their trigger, and those after a document's last trigger
    ends = np.full(len(sizes), -1)
    ends[doc] = t
    tail_from = np.where(ends >= 0, ends + 1, begins)
    for d, a, b in ((doc, before + 1, np.minimum(t - shape.reach, last[doc])), (np.arange(len(sizes)), tail_from, last)):
        n = np.maximum(b - a + 1, 0)
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(np.stack([np.repeat(d, n), place, np.zeros(len(place), np.int64)], 1))
    return np.concatenate(out)


def phrase_hashes(docs: DataFrame, shape: Shape) -> DataFrame:
    """(id, th, phrases: array of (place, starts, times, key, class), known: array of (low, high)):
    documents that hold a start; known: runs of starts that the document itself repeats."""
    ship(docs.sparkSession)
    each = pa.struct([("place", pa.int32()), ("starts", pa.int32()), ("times", pa.int32()), ("key", pa.int64()), ("class", pa.int64())])
    run_ = pa.struct([("low", pa.int32()), ("high", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("phrases", pa.list_(each)), ("known", pa.list_(run_))])
    common, whole, length = shape.length - shape.reach, shape.length, shape.length

    def run(batches):
        from xxhash import xxh64_intdigest as h
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            sizes = [len(t) for t in texts]
            at = 0
            while at < len(texts):  # some megabytes at a time
                to, held = at, 0
                while to < len(texts) and (to == at or held + sizes[to] <= 4 << 20):
                    held, to = held + sizes[to], to + 1
                size = np.array(sizes[at:to], np.int64)
                data = b"".join(texts[at:to])
                found = _phrases(data, size, shape)
                found = found[np.lexsort((found[:, 1], found[:, 0]))]
                ends = np.cumsum(size)
                limit = ends[found[:, 0]].tolist()
                key, cls = np.empty(len(found), np.uint64), np.empty(len(found), np.uint64)
                for i, (_, g, m) in enumerate(found.tolist()):
                    if m:
                        key[i] = h(data[g:g + common], 1)
                        cls[i] = h(data[g - m + 1:min(g + whole, limit[i])], m)
                    else:
                        s = data[g:g + length]
                        key[i], cls[i] = h(s, 2), h(s, 0)
                keep, times, runs = _once(found, cls)
                found, key, cls = found[keep], key[keep], cls[keep]
                begins = ends - size
                place = found[:, 1] - begins[found[:, 0]]
                n = np.bincount(found[:, 0], minlength=to - at)
                rows = np.flatnonzero(n)
                values = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(np.maximum(found[:, 2], 1), pa.int32()), pa.array(times, pa.int32()),
                                                     pa.array(key.view(np.int64)), pa.array(cls.view(np.int64))], fields=list(each))
                known = pa.StructArray.from_arrays([pa.array(runs[:, i] - begins[runs[:, 0]], pa.int32()) for i in (1, 2)], fields=list(run_))
                n_known = np.bincount(runs[:, 0], minlength=to - at)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x[rows])]), pa.int32()), v)
                         for x, v in ((n, values), (n_known, known))]
                take = pa.array(rows + at)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("th").take(take), *lists], schema=schema)
                at = to

    return docs.mapInArrow(tidy(run), "id long, th long, phrases array<struct<place int, starts int, times int, key long, class long>>, known array<struct<low int, high int>>")


def _once(found: np.ndarray, cls: np.ndarray):
    """Of `_phrases` rows in order: (those that stay, so that a string without trigger stands once per
    document; how often the document holds each; runs (document, low, high) of strings it holds again)."""
    at = np.flatnonzero(found[:, 2] == 0)
    at = at[np.lexsort((at, cls[at], found[at, 0]))]
    doc, c = found[at, 0], cls[at]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (c[1:] != c[:-1])])) if len(at) else at
    n = np.diff(np.append(new, len(at)))
    times = np.where(found[:, 2] > 0, 1, 0)
    times[at[new]] = n
    again = found[np.sort(at[np.repeat(n > 1, n)])]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(again[:, 0]) != 0) | (np.diff(again[:, 1]) != 1)])) if len(again) else np.empty(0, np.int64)
    runs = np.stack([again[edge, 0], again[edge, 1], again[np.append(edge, len(again))[1:] - 1, 1]], 1)
    keep = np.flatnonzero(times)
    return keep, times[keep], runs


# --- the order of starts in a share -------------------------------------------

def _sorted(strings: list[bytes]):
    """(place of each string among the different ones in order, common length of each with the one before)."""
    order = sorted(set(strings))
    at = {s: i for i, s in enumerate(order)}
    sizes = np.array([len(s) for s in order])
    wide = int(sizes.max(initial=0))
    flat = np.zeros((len(order), wide + 1), np.int16)
    flat[np.arange(wide + 1)[None] < sizes[:, None]] = np.frombuffer(b"".join(order), np.uint8)
    differ = flat[1:] != flat[:-1]
    differ[:, wide] = True
    common = np.minimum(differ.argmax(1), np.minimum(sizes[1:], sizes[:-1])) if len(order) > 1 else np.empty(0, np.int64)
    return np.array([at[s] for s in strings], np.int64), np.concatenate([[0], common])


def repeated_starts(left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """Boolean (rows, distances): does the string that starts ``distance`` bytes before the
    row's trigger occur in another row too? ``left``: the phrase up to the trigger, ``right``: what follows."""
    before = np.array([len(x) for x in left])
    after = np.array([len(x) for x in right])
    suffix, suffix_common = _sorted([x[::-1] for x in left])
    follow, follow_common = _sorted(right)
    out = np.zeros((len(left), int(before.max(initial=0)) + 1), bool)
    for d in range(out.shape[1]):
        rows = np.flatnonzero((before >= d) & (after >= length - d))
        if len(rows) < 2:
            continue
        # neighbours with enough in common are one group, in either order
        group = np.cumsum(suffix_common < d)[suffix[rows]] if d else np.zeros(len(rows), np.int64)
        place = group * (len(follow_common) + 1) + np.cumsum(follow_common < length - d)[follow[rows]]
        _, inverse, n = np.unique(place, return_inverse=True, return_counts=True)
        out[rows, d] = n[inverse] > 1
    return out


SPANS_DDL = "id long, th long, low int, high int"
SPANS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _share(length: int, size: int = 16384):
    """Rows sorted by key -> runs of repeated starts of those that occur once."""
    def order(rows):
        got = repeated_starts([r[5] for r in rows], [r[6] for r in rows], length)
        ids, ths, low, high = [], [], [], []
        for (_, id_, th, place, n, _, _), hit in zip(rows, got):
            if n == 1 and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # distances a .. b - 1
                    ids.append(id_)
                    ths.append(th)
                    low.append(place - b + 1)
                    high.append(place - a)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, ths, low, high), SPANS.types)], schema=SPANS)

    def run(batches):
        held = []
        for b in batches:
            held += zip(*[b.column(c).to_pylist() for c in ("key", "id", "th", "place", "n", "left", "right")])
            if len(held) >= size:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield order(held[:cut])
                    held = held[cut:]
        if held:
            yield order(held)

    return run


# --- all together ---------------------------------------------------------------

def _joined(docs: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that are listed, with its columns; the others). Rows that a Bloom filter
    of the listed (id, th) doesn't let through pass without a shuffle."""
    h = F.xxhash64("id", "th")
    bits = bloom_size(listed.count())
    words = bloom_words(listed.select(F.explode(F.array(*bloom_cells(h, bits))).alias("cell")))
    d = bloom_hit(docs, h, words, bits, "__hit")
    maybe = d.filter("__hit").drop("__hit").join(listed, ["id", "th"], "left")
    extra = [c for c in listed.columns if c not in ("id", "th")]
    rest = d.filter("not __hit").drop("__hit")
    return maybe.filter(F.col(extra[0]).isNotNull()), rest.unionByName(maybe.filter(F.col(extra[0]).isNull()).drop(*extra))


def repeated_spans(docs: DataFrame, path: str, shape: Shape, hot: int = 512) -> DataFrame:
    """(id, th, spans: array of (low, high)): repeated starts of documents (id, th, text)."""
    spark = docs.sparkSession
    phrase_hashes(docs, shape).write.options(**SMALL).parquet(f"{path}/phrases")
    phrases = spark.read.parquet(f"{path}/phrases")
    rows = phrases.select("id", "th", F.explode("phrases").alias("p")) \
        .select("id", "th", "p.place", "p.starts", "p.times", "p.key", F.col("p.class").alias("cls"))
    # 1: a key of one trigger alone repeats nothing
    shared = attach_group_stats(rows, ["key"], {"n_key": (F.sum("times"), F.sum), "lowest": (F.min("cls"), F.min), "highest": (F.max("cls"), F.max)},
                                ["id", "th", "place"]).filter("n_key > 1")
    shared.select("id", "th", "place", "starts", "times", "key", "cls", (F.col("lowest") != F.col("highest")).alias("several")).write.options(**SMALL).parquet(f"{path}/shared")
    # 2: occurrences of each class
    here = F.struct("id", "th", "place")
    classes = attach_group_stats(spark.read.parquet(f"{path}/shared"), ["key", "cls"], {"n": (F.sum("times"), F.sum), "first": (F.min(here), F.min)},
                                 ["id", "th", "place"])
    classes.withColumn("is_first", F.col("first") == here).drop("first").filter("n > 1 or several").write.options(**SMALL).parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    whole = classes.filter("n > 1").select("id", "th", (F.col("place") - F.col("starts") + 1).alias("low"), F.col("place").alias("high"))
    # 3: one occurrence of each class whose key others share
    firsts = attach_group_stats(classes.filter("several and is_first"), ["key"], {"k": (F.count(F.lit(1)), F.sum)}, ["cls"]) \
        .groupBy("id", "th").agg(F.collect_list(F.struct("place", "starts", "key", "n", "k")).alias("firsts"))
    firsts.write.options(**SMALL).parquet(f"{path}/firsts")
    cut, _ = _joined(docs, spark.read.parquet(f"{path}/firsts"))
    _cut_out(cut, shape.length).write.options(**SMALL).parquet(f"{path}/cut")
    cut = spark.read.parquet(f"{path}/cut")
    cool = cut.filter(F.col("k") <= hot).select("key", "id", "th", "place", "n", "left", "right").repartition("key").sortWithinPartitions("key") \
        .mapInArrow(tidy(_share(shape.length)), SPANS_DDL)
    warm = cut.filter(F.col("k") > hot).withColumn("d", F.explode(F.sequence(
        F.greatest(F.lit(0), shape.length - F.octet_length("right")), F.octet_length("left"))))
    string = F.expr(f"substring(concat(left, right), octet_length(left) - d + 1, {shape.length})")
    warm = warm.filter(f"octet_length(left) >= d and octet_length(right) >= {shape.length} - d") \
        .select("id", "th", (F.col("place") - F.col("d")).alias("low"), "n", F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(1), string).alias("h2"))
    warm = attach_group_stats(warm, ["h1", "h2"], {"times": (F.count(F.lit(1)), F.sum)}, ["id", "th", "low"]).filter("times > 1 and n = 1")
    known = phrases.select("id", "th", F.explode("known").alias("k")).select("id", "th", "k.low", "k.high")
    spans = whole.unionByName(known).unionByName(cool).unionByName(warm.select("id", "th", "low", F.col("low").alias("high")))
    spans.groupBy("id", "th").agg(F.collect_list(F.struct("low", "high")).alias("spans")).write.options(**SMALL).parquet(f"{path}/spans")
    return spark.read.parquet(f"{path}/spans")


def _cut_out(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the listed phrases: left of the trigger and what follows it."""
    ship(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("k", pa.int64()),
                        ("left", pa.binary()), ("right", pa.binary())])

    def run(batches):
        for b in batches:
            for r in range(len(b)):
                id_, th, text = (b.column(c)[r].as_py() for c in ("id", "th", "text"))
                data, out = text.encode(), []
                for f in b.column("firsts")[r].as_py():
                    g = f["place"]
                    out.append((id_, th, g, f["key"], f["n"], f["k"], data[g - f["starts"] + 1:g], data[g:g + length]))
                for at in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at:at + 4096]), schema.types)], schema=schema)

    return docs.select("id", "th", "text", "firsts").mapInArrow(
        tidy(run), "id long, th long, place int, key long, n long, k long, left binary, right binary")


def _remove(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            for r in range(len(b)):
                data = b.column("text")[r].as_py().encode()
                starts = b.column("spans")[r].values
                low, high = starts.field("low").to_numpy(), starts.field("high").to_numpy()
                # a last start whose string passes the end isn't one
                high = np.minimum(high, len(data) - length)
                low, high = low[low <= high], high[low <= high]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, low, 1)
                np.add.at(edge, high + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": [b.column("doc_id")[r].as_py()], "n_bytes": [len(data)], "n_removed": [len(data) - len(kept)],
                                                  "spans": [ends.tolist()], "kept": [kept]}, schema=schema)

    return run


def substring_dedup(docs: DataFrame, length: int = 400, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans: [start, end) byte pairs removed, kept binary) of every document."""
    spark, shape = docs.sparkSession, Shape(length)
    path = path or shared_path(spark, "substring-dedup")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .withColumns({"id": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64("doc_id", "text")})
    spans = repeated_spans(d.select("id", "th", "text"), path, shape)
    hit, rest = _joined(d, spans)
    ddl = "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept binary"
    untouched = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                            F.array().cast("array<array<int>>").alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return hit.select("doc_id", "text", "spans").mapInArrow(tidy(_remove(length)), ddl).unionByName(untouched)


def removal_digests(docs: DataFrame, length: int = 400) -> DataFrame:
    return substring_dedup(docs, length).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                                F.sha2("kept", 256).alias("kept_sha256"))
