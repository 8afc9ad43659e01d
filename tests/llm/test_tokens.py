import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadrisk.llm import packing, token_store
from roadrisk.llm.queries import tokenizer_file
from roadrisk.llm.tokenize import encoder
from tests.conftest import SF
from tests.llm import cases

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  ", "\t", "\n", " a", "a ", "a  b", "a\n b", "a \nb", "don't", "it's,", "x\x1c!\x1cy", "a b", "a 　 b", "<|endoftext|>",
       "é", "é", " ́", "ΑΣ", "日本", "İ", "ŉ", "ſ", "ª", "ǅ", "١2", "…", "!!", "w.,;", ".", "K", "\x85", "👍🏽", "ǆ.", "À,"]


@functools.cache
def fresh(name):
    return Tokenizer.from_file(tokenizer_file(name))


def whole(name, text):
    """Ids by a tokenizer that the library under test never touched."""
    return np.array(fresh(name).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD + ["the ", "Word ", "word, "]), st.text(max_size=6)), max_size=12))
def test_pieces_give_the_ids_of_the_whole_text(name, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    enc = encoder(tokenizer_file(name))
    assert enc.ids(text) == whole(name, text)


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_are_the_librarys(name):
    enc, plain = encoder(tokenizer_file(name)), encoder(tokenizer_file(name), plain=True)
    for a in fresh(name).get_added_tokens_decoder().values():
        for text in (f"hello {a.content} world", a.content, f"x{a.content}{a.content.upper()} \n{a.content}y"):
            assert enc.ids(text) == whole(name, text)
        text = f"hello {a.content} world"
        assert plain.ids(text) != whole(name, text)
    other = Tokenizer.from_file(tokenizer_file(name))
    other.encode_special_tokens = True
    assert plain.ids("hello <|endoftext|> you") == np.array(other.encode("hello <|endoftext|> you", add_special_tokens=False).ids, "<u4").tobytes()


def test_words_met_once_drive_out_no_others():
    enc = encoder(tokenizer_file(FILES[1]), keep=200)
    calls = []
    new = enc.bare._new
    enc.bare._new = lambda piece: (calls.append(piece), new(piece))[1]
    for i in range(400):
        enc.ids(f"hot words stay once{i} only{i}")
    assert calls.count("hot") == calls.count("stay") == 1 and len(enc.bare) + len(enc.bare.old) <= 210


@pytest.mark.parametrize("name", FILES)
def test_given_documents_and_a_small_table(name):
    import pyarrow.parquet as pq
    small = encoder(tokenizer_file(name), keep=50)
    for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist():
        assert small.ids(t) == whole(name, t)


def expected(rows, name, end_id):
    return [(r[0], whole(name, r[1] or "") + np.uint32(end_id).tobytes()) for r in rows]


def test_store_round_trip(spark, tmp_path):
    rows = [r for r in cases.texts() if r[0] is not None] + [(300, "hello <|endoftext|> world", "en", "b", 1)]
    path = str(tmp_path / "store")
    got = token_store.token_digests(cases.documents(spark, rows), path, tokenizer_file(FILES[0])).collect()
    want = sorted(((d, len(i) // 4, zlib.crc32(i)) for d, i in expected(rows, FILES[0], 2)))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at
        at += r.n_tokens
    # short-document access, through the offset index
    some = {d: i for d, i in expected(rows, FILES[0], 2) if d in (1, 4, 10)}
    assert {r.doc_id: bytes(r.ids) for r in token_store.read_documents(spark, path, [1, 4, 10, 10**9]).collect()} == some
    # another dictionary is refused
    spark.createDataFrame([("0" * 64, bytearray(b""), "x", 2)], "dict_hash string, dictionary binary, tokenizer string, width int") \
        .write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_store(spark, path).collect()


def test_store_uses_its_dictionary(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_store.write_store(docs, str(tmp_path / "s"), tokenizer_file(FILES[0]))
    _, dictionary, width = token_store._dictionary(spark, str(tmp_path / "s"))
    assert len(dictionary) > 1000 and width == 2


def test_shards_follow_the_bytes_of_the_texts(spark, tmp_path):
    rows = [(i, f"word{i} " * 500, "en", "s", 1) for i in range(400)]
    docs = cases.documents(spark, rows)
    size = sum(len(r[1]) for r in rows)
    assert token_store.shards_for(docs, 100_000) == -(-size // 100_000) and token_store.shards_for(docs, 100_000, 3) == 3
    assert token_store.shards_for(docs) == min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20)))
    assert token_store.shards_for(docs.filter("false")) == 1
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    token_store.write_store(docs, many, tokenizer_file(FILES[0]), shard_bytes=100_000)
    token_store.write_store(docs, few, tokenizer_file(FILES[0]))
    assert spark.read.parquet(f"{many}/blocks").select("shard").distinct().count() > 10
    got = [sorted((r.doc_id, r.start, bytes(r.ids)) for r in token_store.read_store(spark, p).collect()) for p in (many, few)]
    assert got[0] == got[1] and len(got[0]) == 400


def test_store_with_null_ids_and_empty_table(spark, tmp_path):
    rows = cases.texts()
    got = token_store.token_digests(cases.documents(spark, rows), str(tmp_path / "a"), tokenizer_file(FILES[0])).collect()
    assert len(got) == len(rows) and min(r.start for r in got) == 0 and {r.start == 0 for r in got if r.doc_id is not None} == {False}
    assert token_store.token_digests(cases.documents(spark, []), str(tmp_path / "b"), tokenizer_file(FILES[0])).count() == 0


def check_packing(got, rows, limit=4096):
    want = sorted(((d, p, s, min(limit, len(i) // 4 - s), zlib.crc32(i[4 * s:4 * (s + limit)]))
                   for d, i in expected(rows, FILES[1], 1) for p, s in enumerate(range(0, len(i) // 4, limit))), key=repr)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= limit
    return len(bins)


def test_packing(spark):
    rows = [*cases.texts(), (300, "a <|startoftext|> b <|ENDOFTEXT|> c <|endoftext|>", "en", "b", 1)]
    got = packing.packed_documents(cases.documents(spark, rows), tokenizer_file(FILES[1])).collect()
    n = check_packing(got, rows)
    assert n <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.packed_documents(cases.documents(spark, []), tokenizer_file(FILES[1])).count() == 0


def test_packing_in_many_groups(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in np.minimum(64, rng.geometric(0.08, 3000))]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(sizes)], "id long, length long, gap string, __extra int")
    got = packing.pack(df, limit=64, group=200).collect()
    assert sorted((r.id, r.length) for r in got) == list(enumerate(sizes)) and got[0].gap == "x"
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(sizes) // 64) + 1


def test_every_piece_goes_where_the_squares_are_least():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 13, 60)
        bins, offsets, gaps = packing.sum_of_squares(sizes, 12)
        gap_of: dict[int, int] = {}
        squares = lambda g: sum(list(g.values()).count(h) ** 2 for h in range(1, 12))
        for s, b in zip(sizes.tolist(), bins.tolist()):
            options = [squares({**gap_of, x: h - s}) for x, h in gap_of.items() if h >= s] + [squares({**gap_of, len(gap_of): 12 - s})]
            gap_of[b] = gap_of.get(b, 12) - s
            assert squares(gap_of) == min(options)
        assert [gap_of[b] for b in range(len(gap_of))] == gaps.tolist()
