"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE of the tokenizers library (over " " + text), B
a sentencepiece model (which puts the space there itself). All work on tokens is
done on Arrow tables of a block of documents: token lists are flattened with
the number of their document, cumulative sums of the tokens' byte lengths give
their ends (a document's sum starts where the one before ends, so an end is a
document-end key, unique in its block), a full Acero hash join on these keys
merges the two lists of ends, and every interval between neighbouring ends is
one link: an A token and a B token that share bytes. Where both end, a group
ends. `Table.group_by` counts a block's id pairs; Spark adds the counts up over
the corpus.

A block leaves its task as one row: its different pairs with their counts, and the
links as places in that list (compressed). The rows are written to the shared folder.
Only (block, pair) rows shuffle to be added up; each pair's count, and whether it is
its B id's highest, go back to their blocks, where a second Arrow pass takes sums
per document. No pair table is collected or broadcast.

Edge cases: a text that is null, empty, or whose tokens' joined bytes differ
from " " + text for one of the tokenizers has no tokens (zeros, empty
groups). Strings of special tokens are ordinary text. Repeated rows count as often
as they occur; null ids are kept; a very long text is a block of its own. An
empty table gives an empty result; columns other than the id and the text aren't read.
"""

from __future__ import annotations

import re
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, shared_path, ship, tidy
from .tokenize import encoder

#: bytes of text in a block (a longer text is a block alone)
BLOCK_BYTES = 2 << 20
#: pieces of text whose ids a worker remembers, per tokenizer
KEEP = 400_000

_models: dict[str, Pieces] = {}


class Pieces:
    """A sentencepiece model; ids of text pieces met before are remembered.

    If no entry of the vocabulary holds a space mark after another character, or
    a line break, the model never merges over the start of a run of spaces or
    over a line break, and texts may be cut there."""

    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece
        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.entries = pa.array([bytes.fromhex(byte.fullmatch(p)[1]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace("▁", " ").encode()
                                 for i, p in enumerate(names)], pa.binary())
        self.cuts = m.encode("a") == m.encode("a ")[:len(m.encode("a"))] and not any("\n" in p or "▁" in p.lstrip("▁") for p in names)
        self.keep, self.break_ids = keep, m.encode("\n")
        # encode puts a space before its text; after a line break none is wanted
        self.led = _Met(lambda word: m.encode(word) if word else self.break_ids[:-1])
        self.bare = _Met(lambda word: m.encode("\n" + word)[len(self.break_ids):])

    def ids(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if not self.cuts or not text or "\0" in text or "▁" in text:
            ids = self.model.encode(text)
            return pack(f"<{len(ids)}I", *ids)
        led, bare = self.led, self.bare
        if len(led) + len(bare) > self.keep // 2:
            led.turn()
            bare.turn()
        if any(x in text for x in ("  ", " \n", "\n ")) or text[0] == " " or text[-1] == " ":
            return b"".join([led[p[1:]] if p[0] == " " else bare[p] for p in _PIECE.findall(" " + text)])
        out = []
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if not i:
                out.append(led[first])
            else:
                out.append(bare["\n"])
                if first:
                    out.append(bare[first])
            out.extend(map(led.__getitem__, rest))
        return b"".join(out)


class _Met(dict):
    """Piece -> its ids as bytes, in two generations: see `tokenize.Known`."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = self.encode(piece)
            out = pack(f"<{len(ids)}I", *ids)
        self[piece] = out
        return out

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


_PIECE = re.compile(r" +[^ \n]*|\n|[^ \n]+")


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def byte_level_entries(tokenizer) -> pa.Array:
    """The bytes of every id of a byte-level vocabulary."""
    # the alphabet: printable bytes stand for themselves, the others for the characters from 256 on
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in same)}
    names = {i: t for t, i in tokenizer.get_vocab().items()}
    return pa.array([bytes(back[c] for c in names.get(i, "") if c in back) for i in range(max(names) + 1)], pa.binary())


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, KEEP, plain=True), pieces(path_b)
        self.bytes_a, self.bytes_b = byte_level_entries(self.a.tokenizer), self.b.entries
        self.wide = len(self.bytes_b)

    def tokens(self, texts: list[str | None]):
        """Two lists of id lists; both lists empty where a text has no tokens."""
        ids = [[], []]
        for t in texts:
            if not t:
                ids[0].append(b"")
                ids[1].append(b"")
                continue
            ids[0].append(self.a.ids(t, lead=True))
            ids[1].append(self.b.ids(t))
        lists = [_lists(x) for x in ids]
        want = ["" if not t else " " + t for t in texts]
        if any(_joined(e, x.values) != "".join(want).encode() for e, x in zip((self.bytes_a, self.bytes_b), lists)):
            good = [_joined(self.bytes_a, lists[0][i].values) == w.encode() == _joined(self.bytes_b, lists[1][i].values) for i, w in enumerate(want)]
            lists = [_lists([x if g else b"" for x, g in zip(col, good)]) for col in ids]
        return lists

    def links(self, a: pa.Array, b: pa.Array) -> pa.Table:
        """One row per link of a block's documents, in order: doc, pair (A id times B's
        vocabulary plus B id), new_a, new_b (the link is its A, B token's first)."""
        side = lambda ids, entries, name: pa.table({
            "end": pc.cumulative_sum(pc.binary_length(entries).take(ids.values).cast(pa.int64())),
            f"doc_{name}": pc.list_parent_indices(ids),
            f"at_{name}": pa.array(np.arange(len(ids.values)))})
        both = side(a, self.bytes_a, "a").join(side(b, self.bytes_b, "b"), "end", join_type="full outer", use_threads=False).sort_by("end")
        # an interval belongs to the first token that ends at or after its end
        at_a, at_b = pc.fill_null_backward(both["at_a"]), pc.fill_null_backward(both["at_b"])
        doc = pc.fill_null_backward(both["doc_a"])
        first = lambda at: pa.array(np.diff(at.to_numpy(), prepend=-1) > 0)
        pair = pc.add(pc.multiply(a.values.take(at_a).cast(pa.int64()), self.wide), b.values.take(at_b).cast(pa.int64()))
        return pa.table({"doc": doc, "pair": pair, "new_a": first(at_a), "new_b": first(at_b)})


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _joined(entries: pa.Array, ids: pa.Array) -> bytes:
    """The tokens' bytes, joined: the value buffer of a take."""
    if not len(ids):
        return b""
    took = entries.take(ids)
    start, end = np.frombuffer(took.buffers()[1], np.int32)[[took.offset, took.offset + len(took)]]
    return took.buffers()[2][start:end].to_pybytes()


def _pairs(links: pa.Table) -> pa.Table:
    """A block's different pairs with their counts, the most frequent first."""
    return links.group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by([("pair_count", "descending"), ("pair", "ascending")])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def write_links(docs: DataFrame, path: str, path_a: str, path_b: str) -> None:
    """One row per block: doc_ids, links of each document, different pairs with their
    counts, and per link its place among these and whether it begins an A or B token."""
    ship(docs.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("width", pa.int32()), ("places", pa.binary()), ("begins", pa.binary())])

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        al, zip_ = aligner(path_a, path_b), zstandard.ZstdCompressor(level=1)
        block = TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0

        def flush():
            nonlocal block, ids, texts, held
            a, b = al.tokens(texts)
            t = al.links(a, b)
            pairs = _pairs(t)
            place = pc.index_in(t["pair"], value_set=pairs["pair"].combine_chunks()).to_numpy()
            width = 2 if len(pairs) <= 1 << 16 else 4
            # bytes of equal weight together: they compress better
            raw = np.ascontiguousarray(place.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes() if len(place) else b""
            begins = np.packbits(np.stack([t["new_a"].to_numpy(), t["new_b"].to_numpy()]), axis=1).tobytes() if len(place) else b""
            per_doc = np.bincount(t["doc"].to_numpy(), minlength=len(ids)) if len(place) else np.zeros(len(ids), np.int64)
            row = {"block": [block], "doc_ids": [ids], "n_links": [per_doc.tolist()], "pairs": [pairs["pair"].to_pylist()],
                   "counts": [pairs["pair_count"].to_pylist()], "width": [width], "places": [zip_.compress(raw)], "begins": [zip_.compress(begins)]}
            block, ids, texts, held = block + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                size = len(t or "")
                if held and held + size > BLOCK_BYTES:
                    yield flush()
                ids.append(d)
                texts.append(t)
                held += size
        if ids:
            yield flush()

    ddl = ("block long, doc_ids array<long>, n_links array<long>, pairs array<long>, counts array<long>, width int, "
           "places binary, begins binary")
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), ddl) \
        .write.options(**few_rows(16 << 20)).parquet(path)


def pair_counts(blocks: DataFrame, wide: int) -> DataFrame:
    """(pair, a_id, b_id, count, best): corpus-wide; best: no pair of this B id counts more."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = rows.groupBy("pair").agg(F.sum("n").alias("count")).withColumns({
        "a_id": F.expr(f"cast(pair div {wide} as int)"), "b_id": F.expr(f"cast(pair % {wide} as int)")})
    # at most one row per A id in a window: bounded by that vocabulary
    return total.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def align(docs: DataFrame, path_a: str, path_b: str, path: str | None = None):
    """(documents, pairs). documents: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups (a1,a2|b1;a3|b2,b3: the ids of each group); pairs as in `pair_counts`."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "alignment")
    write_links(docs, f"{path}/blocks", path_a, path_b)
    blocks = spark.read.parquet(f"{path}/blocks")
    wide = pieces(path_b).model.get_piece_size()
    pair_counts(blocks, wide).write.parquet(f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs")
    # a pair occurs once per block that holds it; its count goes back to all of them
    wanted = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(pairs.select("pair", "count", "best"), "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", F.when(F.col("best"), -F.col("count")).otherwise(F.col("count")).alias("count")))).alias("found"))
    # signed: a best pair's count is negative, half the bytes to carry
    rows = blocks.drop("counts").join(found.select("block", F.col("found.count").alias("counts")), "block", "left")
    return rows.mapInArrow(tidy(_document_sums(wide)), DOCUMENT_DDL), pairs


DOCUMENTS = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                       ("groups", pa.string())])
DOCUMENT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _document_sums(wide: int):
    def run(batches):
        import zstandard
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(len(b)):
                row = {n: b.column(n)[i] for n in b.schema.names}
                per_doc = row["n_links"].values.to_numpy()
                n, width = int(per_doc.sum()), row["width"].as_py()
                raw = np.frombuffer(unzip.decompress(row["places"].as_py()), np.uint8) if n else np.empty(0, np.uint8)
                place = np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)
                bits = np.frombuffer(unzip.decompress(row["begins"].as_py()), np.uint8).reshape(2, -1) if n else np.zeros((2, 0), np.uint8)
                begins = np.unpackbits(bits, axis=1, count=n).astype(bool)
                signed = row["counts"].values.to_numpy() if n else np.empty(0, np.int64)
                pair = row["pairs"].values.to_numpy()
                parent = pa.array(np.repeat(np.arange(len(per_doc)), per_doc))
                yield _one_block(row["doc_ids"].values, per_doc, parent, pair[place] if n else place, signed[place] if n else place, begins, wide)

    return run


def _one_block(doc_ids, per_doc, parent, pair, signed, begins, wide) -> pa.RecordBatch:
    group = begins.all(0)
    t = pa.table({"doc": parent, "a": begins[0].astype(np.int64), "b": begins[1].astype(np.int64), "g": group.astype(np.int64),
                  "best": (signed < 0).astype(np.int64), "count": np.abs(signed)})
    sums = t.group_by("doc", use_threads=False).aggregate([(c, "sum") for c in t.column_names[1:]])
    out = {c: np.zeros(len(per_doc), np.int64) for c in t.column_names[1:]}
    for c in out:
        out[c][sums["doc"].to_numpy()] = sums[f"{c}_sum"].to_numpy()
    if len(pair):
        number = np.cumsum(group) - 1

        def ids(which, values):
            """The decimal ids of each group, joined by commas."""
            mine = begins[which]
            starts = np.searchsorted(number[mine], np.arange(number[-1] + 2)).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(starts, pa.array(values[mine]).cast(pa.string())), ",")

        both = pc.binary_join_element_wise(ids(0, pair // wide), ids(1, pair % wide), "|")
        texts = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(out["g"])]).astype(np.int32), both), ";")
    else:
        texts = pa.array([""] * len(per_doc), pa.string())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(out["a"]), pa.array(out["b"]), pa.array(out["g"]), pa.array(per_doc),
                                       pa.array(out["best"]), pa.array(out["count"]), texts], schema=DOCUMENTS)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    documents, _ = align(docs, path_a, path_b)
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return documents.withColumn("groups_sha256", sha).drop("groups")
