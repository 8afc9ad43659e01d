"""Vector code compression: product codes by Lloyd rounds over cover trees.

Vectors become integers (floor(scale * x)) and are cut into equal parts; each
part position has a codebook, refined by Lloyd rounds in exact integers.

Each task turns its vectors into blocks and, for each block and part, builds
a cover tree: a node's children are centres more than half its scale apart
(scales are powers of two), every point hangs under the first centre that
covers it, and points stand in tree order, so that a node is a run of points
and cumulative sums give any node's sum as a difference. The trees are written
once into the shared folder. A round reads them and walks all nodes of a level
together: where the nearest entry is nearer than every other by more than twice
the node's radius, the whole subtree joins it (count and sum by two cumulative
sums); other nodes go on to their children, and leaves that stay ambiguous
compare their points exactly. Only (part, entry) sums leave a task; the
codebooks, whose size is a parameter, are the only thing the driver holds.

Edge cases: rows whose vector is null or holds a null or non-finite component
are dropped. Repeated vec_ids are rows of their own; ids that are null come last
when codebooks start, equal ids go by the vector. With fewer kept vectors than
``entries``, a codebook has as many entries as there are vectors. A vector
whose length isn't that of the first kept one (in vec_id order), or not a positive
multiple of ``parts``, stays without code (null code and error; it teaches
nothing). Components must stay below 2^25 after scaling, so that distances are
exact; larger ones are an error. Only vec_id, the vector and the label are
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group_stats, few_rows, shared_path, ship, tidy

#: scaled components lie below this: squared distances of parts are exact in 64 bits
LARGEST = 1 << 25


# --- one cover tree ------------------------------------------------------------

@dataclass
class Tree:
    """Nodes by level, parents first. ``order``: the points in tree order; node k
    holds order[start[k]:end[k]], its centre is the point ``centre[k]``, its children
    are the nodes first[k]:last[k] (none: a leaf)."""
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = 24) -> Tree:
    """Cover tree of integer points (n, d); nodes of at most ``leaf`` points, or
    of one repeated point, have no children."""
    n = len(points)
    p = points.astype(np.float64)  # exact: below 2^25
    order = np.arange(n)
    start, end, centre = np.array([0]), np.array([n]), np.array([0])
    out = {k: [] for k in ("start", "end", "centre", "radius", "first", "last")}
    made = 1
    while len(start):
        # radius: the farthest point of each node (nodes of a level are disjoint runs, in order)
        sizes = end - start
        owner = np.repeat(np.arange(len(start)), sizes)
        runs = np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        ids = order[runs]
        far = ((p[ids] - p[centre][owner]) ** 2).sum(1)
        r2 = np.maximum.reduceat(far, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        split = (sizes > leaf) & (r2 > 0)
        # children cover half the node's scale (the power of two that holds its radius)
        cover2 = np.where(split, 4.0 ** (np.ceil(np.log2(np.maximum(r2, 1)) / 2) - 1), 0)
        # the first point not yet covered is the next child's centre, in all nodes at once
        free = np.flatnonzero(split[owner])
        child = np.full(len(ids), -1)
        kids = np.zeros(len(start), np.int64)
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        # a node's own centre is its first child's centre
        here = np.flatnonzero(split)
        c = centre[here]
        while len(here):
            seat = np.searchsorted(here, owner[free])
            near = ((p[ids[free]] - p[c][seat]) ** 2).sum(1) <= cover2[owner[free]]
            child[free[near]] = kids[owner[free[near]]]
            centres.append((here, c))
            kids[here] += 1
            free = free[~near]
            o = owner[free]
            heads = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.empty(0, np.int64)
            here, c = o[heads], ids[free[heads]]
        out["start"].append(start)
        out["end"].append(end)
        out["centre"].append(centre)
        out["radius"].append(np.sqrt(r2))
        before = np.concatenate([[0], np.cumsum(kids)[:-1]])
        out["first"].append(np.where(split, made + before, 0))
        out["last"].append(np.where(split, made + before + kids, 0))
        made += int(kids.sum())
        if not split.any():
            break
        # put each node's points in the order of its children, and go down
        inner = split[owner]
        key = np.where(inner, child, 0)
        by = np.lexsort((key, owner))
        order[runs] = ids[by]
        number = (before[owner] + key)[inner]
        counts = np.bincount(number, minlength=int(kids.sum()))
        centre = np.empty(len(counts), np.int64)
        for k, (nodes, c) in enumerate(centres):
            centre[before[nodes] + k] = c
        base = np.concatenate([[0], np.cumsum(counts)[:-1]])
        first_child = before[split]
        starts = base - np.repeat(base[first_child], kids[split]) + np.repeat(start[split], kids[split])
        start, end = starts, starts + counts
    return Tree(order, *[np.concatenate(out[k]) for k in ("start", "end", "centre", "radius", "first", "last")])


class Walk:
    """A block's part with its tree: points in tree order, cumulative sums at the nodes' ends."""

    def __init__(self, points: np.ndarray, start, end, centre, radius, first, last):
        self.points, self.start, self.end, self.radius, self.first, self.last = points, start, end, radius, first, last
        self.centre = centre  # place in tree order
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])

    def settle(self, book: np.ndarray):
        """((start, end, entry) of whole subtrees, (places, entry) of points compared one by one)."""
        k = len(book)
        level = np.array([0])
        whole, singles = [], []
        f = book.astype(np.float64)
        while len(level):
            d = np.sqrt(_squares(self.points[self.centre[level]], f))
            entry = d.argmin(1)
            if k == 1:
                sure = np.ones(len(level), bool)
            else:
                two = np.partition(d, 1, axis=1)[:, :2]
                # strictly nearer for every point; the margin is far above rounding
                sure = two[:, 1] - two[:, 0] > 2 * self.radius[level] + 1e-6 * (1 + two[:, 1])
            done = level[sure]
            whole.append(np.stack([self.start[done], self.end[done], entry[sure]], 1))
            rest = level[~sure]
            leaf = self.first[rest] == self.last[rest]
            singles.append(_runs(self.start[rest[leaf]], self.end[rest[leaf]]))
            level = _runs(self.first[rest[~leaf]], self.last[rest[~leaf]])
        places = np.concatenate(singles)
        return np.concatenate(whole), places, nearest(self.points[places], book)

    def totals(self, book: np.ndarray):
        """Per entry: count and component sums of the points assigned to it."""
        whole, places, entry = self.settle(book)
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        np.add.at(count, whole[:, 2], whole[:, 1] - whole[:, 0])
        np.add.at(total, whole[:, 2], self.sums[whole[:, 1]] - self.sums[whole[:, 0]])
        np.add.at(count, entry, 1)
        np.add.at(total, entry, self.points[places])
        return count, total

    def assigned(self, book: np.ndarray):
        """Entry of every point, and its squared distance."""
        whole, places, entry = self.settle(book)
        out = np.empty(len(self.points), np.int64)
        out[_runs(whole[:, 0], whole[:, 1])] = np.repeat(whole[:, 2], whole[:, 1] - whole[:, 0])
        out[places] = entry
        return out, ((self.points - book[out]) ** 2).sum(1)


def _runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the runs start[i]:end[i], one run after the other."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.stack([((points - b) ** 2).sum(1) for b in book], 1)


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry in exact integers; of equally near ones the lowest."""
    return _squares(points, book.astype(np.int64)).argmin(1) if len(points) else np.empty(0, np.int64)


# --- blocks of vectors with their trees, as rows -----------------------------

NODES = ("start", "end", "centre", "radius", "first", "last")
#: one row per block; lists hold one binary per part
BLOCK = pa.schema([("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("points", pa.list_(pa.binary())),
                   ("place", pa.list_(pa.binary())), *[(f"node_{k}", pa.list_(pa.binary())) for k in NODES]])
BLOCK_DDL = ("vec_id array<long>, label array<long>, points array<binary>, place array<binary>, "
             + ", ".join(f"node_{k} array<binary>" for k in NODES))


def _block_row(ids, labels, ints: np.ndarray, parts: int) -> pa.RecordBatch:
    width = ints.shape[1] // parts
    row = {n: [] for n in BLOCK.names[2:]}
    for j in range(parts):
        sub = np.ascontiguousarray(ints[:, j * width:(j + 1) * width])
        t = cover_tree(sub)
        place = np.empty(len(sub), np.int64)
        place[t.order] = np.arange(len(sub))
        row["points"].append(sub[t.order].astype("<i4").tobytes())
        row["place"].append(place.astype("<i4").tobytes())
        for k, v in {"start": t.start, "end": t.end, "centre": place[t.centre], "first": t.first, "last": t.last}.items():
            row[f"node_{k}"].append(v.astype("<i4").tobytes())
        row["node_radius"].append(t.radius.astype("<f8").tobytes())
    return pa.RecordBatch.from_pydict({"vec_id": [ids], "label": [labels], **{k: [v] for k, v in row.items()}}, schema=BLOCK)


def _walks(b: pa.RecordBatch, i: int, width: int):
    """The walks of a block's parts, one after the other."""
    cols = {n: b.column(n)[i].values for n in b.schema.names if n == "points" or n.startswith("node_")}
    for j in range(len(cols["points"])):
        raw = lambda name, kind="<i4": np.frombuffer(cols[name][j].as_buffer(), kind)
        n = {k: raw(f"node_{k}").astype(np.int64) for k in NODES if k != "radius"}
        yield j, Walk(raw("points").reshape(-1, width).astype(np.int64), n["start"], n["end"], n["centre"],
                      raw("node_radius", "<f8"), n["first"], n["last"])


def write_trees(vectors: DataFrame, path: str, width: int, parts: int, block: int = 8192) -> None:
    """(vec_id, label, ints array<long>) rows -> one row per block, with a cover tree per part."""
    ship(vectors.sparkSession)

    def run(batches):
        ids, labels, rows, held = [], [], [], 0
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            labels += b.column("label").to_pylist()
            rows.append(np.asarray(b.column("ints").flatten()).reshape(-1, width * parts))
            held += len(b)
            while held >= block:
                ints = np.concatenate(rows)
                yield _block_row(ids[:block], labels[:block], ints[:block], parts)
                ids, labels, rows, held = ids[block:], labels[block:], [ints[block:]], held - block
        if held:
            yield _block_row(ids, labels, np.concatenate(rows), parts)

    vectors.mapInArrow(tidy(run), BLOCK_DDL).write.options(**few_rows(8 << 20)).parquet(path)


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: floored means of what each entry gets."""
    width = books[0].shape[1]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        counts, totals = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), *books[0].shape), np.int64)
        for b in batches:
            for i in range(len(b)):
                for j, w in _walks(b, i, width):
                    count, total = w.totals(books[j])
                    counts[j] += count
                    totals[j] += total
        j, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[j, e]),
                                          pa.array(totals[j, e].tolist(), pa.list_(pa.int64()))], schema=schema)

    got = trees.select("points", *[f"node_{k}" for k in NODES]).mapInArrow(tidy(run), "part int, entry int, n long, sums array<long>") \
        .groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in got.collect():  # parts x entries rows
        out[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def encode(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code binary: one byte per part, error long) of every vector in the trees."""
    parts, width = len(books), books[0].shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.binary()), ("error", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                ids, labels, places = (b.column(n)[i].values for n in ("vec_id", "label", "place"))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for j, w in _walks(b, i, width):
                    entry, miss = w.assigned(books[j])
                    place = np.frombuffer(places[j].as_buffer(), "<i4")
                    codes[:, j] = entry[place]
                    error += miss[place]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], schema=schema)

    return trees.mapInArrow(tidy(run), "vec_id long, label long, code binary, error long")


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
                     id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
    """(codes, codebooks): codes has (vec_id, label, code binary of one byte per
    part, error long); codebooks is a list of integer arrays (entries, width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: entries must be 1 to 256")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("__v")) \
        .filter(F.col("__v").isNotNull() & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    too_far = F.raise_error(F.lit(f"a vector's component times {scale} is not below {LARGEST}"))
    ints = F.transform("__v", lambda x: F.when(F.abs(x) * scale < LARGEST - 1, F.floor(x * scale)).otherwise(too_far.cast("long")))
    kept = kept.select("vec_id", "label", ints.alias("ints"))
    by = [F.col("vec_id").asc_nulls_last(), F.col("ints").asc()]
    first = [r.ints for r in kept.orderBy(*by).limit(1).collect()]
    size = len(first[0]) if first else 0
    none = kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if size == 0 or size % parts:
        return none, []
    width = size // parts
    fits = F.size("ints") == size
    start = np.array([r.ints for r in kept.filter(fits).orderBy(*by).limit(entries).collect()], np.int64)
    books = [start[:, j * width:(j + 1) * width] for j in range(parts)]
    path = shared_path(spark, "cover-trees")
    write_trees(kept.filter(fits), path, width, parts)
    trees = spark.read.parquet(path)
    for _ in range(rounds):
        books = _round(trees, books)
    return encode(trees, books).unionByName(none.filter(F.size("ints") != size)), books


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code hex, error, label_error: errors summed over equal labels, codebooks_sha256)."""
    codes, books = compress_vectors(vectors, parts, entries, rounds)
    sha = hashlib.sha256(books_text(books).encode()).hexdigest()
    path = shared_path(vectors.sparkSession, "vector-codes")
    codes.withColumns({"__none": F.col("label").isNull(), "__label": F.coalesce("label", F.lit(0))}).write.parquet(path)
    rows = attach_group_stats(vectors.sparkSession.read.parquet(path), ["__none", "__label"],
                              {"label_error": (F.sum("error"), F.sum)}, ["vec_id"])
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
