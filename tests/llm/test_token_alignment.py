import functools
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadrisk.llm import token_alignment as ta
from roadrisk.llm.queries import tokenizer_file
from tests.conftest import SF
from tests.llm import cases

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.cache
def fresh():
    import sentencepiece
    t = Tokenizer.from_file(tokenizer_file(A))
    t.encode_special_tokens = True
    # the byte of every character of the byte-level alphabet, by encoding and decoding
    from tokenizers.pre_tokenizers import ByteLevel
    char = {}
    for b in range(128):
        char[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]] = b
    for c in range(128, 0x800):
        for ch, b in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0], chr(c).encode()):
            char[ch] = b
    for c in [*range(0x800, 0xd800, 64), *range(0xe000, 0x10000, 64), *range(0x10000, 0x10ffff, 4096)]:
        for ch, b in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0], chr(c).encode()):
            char[ch] = b
    return t, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B)), char


def plain(text):
    """(ids, token bytes) of both tokenizers, by the libraries alone."""
    t, sp, char = fresh()
    ea = t.encode(" " + text, add_special_tokens=False)
    ib = sp.encode(text)
    as_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return (ea.ids, [bytes(char[c] for c in x) for x in ea.tokens]), (ib, [as_bytes(i) for i in ib])


def brute(rows):
    docs = []
    for d, text in rows:
        (ia, ba), (ib, bb) = plain(text) if text else (([], []), ([], []))
        if not text or not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            docs.append((d, [], [], []))
            continue
        spans = []
        for toks in (ba, bb):
            at, out = 0, []
            for x in toks:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((ia[i], ib[k]))
                k += 1
        groups, i, j = [], 0, 0
        while i < len(ia):
            k, m = i + 1, j + 1
            while spans[0][k - 1][1] != spans[1][m - 1][1]:
                if spans[0][k - 1][1] < spans[1][m - 1][1]:
                    k += 1
                else:
                    m += 1
            groups.append((",".join(map(str, ia[i:k])), ",".join(map(str, ib[j:m]))))
            i, j = k, m
        docs.append((d, (ia, ib), links, groups))
    count = Counter(x for _, _, links, _ in docs for x in links)
    best = {}
    for (a, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, ids, links, groups in docs:
        text = ";".join("|".join(g) for g in groups)
        out.append((d, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count


ODD = ["", " ", "  ", "\n", "\t", " a", "a ", "don't", "the ", "Word ", "▁", "▁x", "<0x0A>", "<s>", "</s>", "<unk>", "<|endoftext|>", "\0",
       "é", "日本", "👍🏽", "\r\n", "\x85", "ﬁ", "１", "a\nb", "\n\n ", "x́", "...", "10.0.0.7", "﻿", "​"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=5)), max_size=10))
def test_ids_are_the_libraries(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    al = ta.aligner(tokenizer_file(A), tokenizer_file(B))
    (ia, _), (ib, _) = plain(text)
    assert np.frombuffer(al.a.ids(text, lead=True), "<u4").tolist() == ia and np.frombuffer(al.b.ids(text), "<u4").tolist() == ib


def check(spark, rows, **columns):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(columns).repartition(3)
    want, count = brute(rows)
    got = ta.alignment_digests(df, tokenizer_file(A), tokenizer_file(B))
    assert sorted((tuple(r[f] for f in FIELDS) for r in got.collect()), key=repr) == sorted(want, key=repr)
    return count


def test_awkward_texts(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [(r[0], r[1]) for r in cases.texts() if r[0] not in (11,)]
    rows += [(400 + i, f"one {x} two{x}three") for i, x in enumerate(ODD)] + [(500 + i, x) for i, x in enumerate(ODD)]
    check(spark, rows, pair=F.lit("p"), block=F.lit(1), groups=F.lit(2), count=F.lit(3), label=F.lit("l"))


def test_small_blocks_and_pairs(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    count = check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    docs, pairs = ta.align(df, tokenizer_file(A), tokenizer_file(B), str(tmp_path / "x"))
    assert {(r.a_id, r.b_id): r["count"] for r in pairs.collect()} == dict(count)
    # every link's tokens spell the same bytes: groups rebuild the text
    al, texts = ta.aligner(tokenizer_file(A), tokenizer_file(B)), dict(rows)
    for r in docs.limit(20).collect():
        for g in filter(None, r.groups.split(";")):
            a, b = ([int(x) for x in s.split(",")] for s in g.split("|"))
            assert b"".join(al.bytes_a[i].as_py() for i in a) == b"".join(al.bytes_b[i].as_py() for i in b)
        whole = b"".join(al.bytes_a[int(x)].as_py() for g in r.groups.split(";") if g for x in g.split("|")[0].split(","))
        assert whole.decode() in ("", " " + (texts[r.doc_id] or ""))


def test_empty_and_tokenless_tables(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ""), (None, "▁")])


@pytest.mark.parametrize("size", [1, 200])
def test_block_size_changes_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(ta, "BLOCK_BYTES", size)
    al = ta.Aligner(tokenizer_file(A), tokenizer_file(B))
    texts = ["some words here", "", None, "more wörds\nthere  x"]
    whole = al.links(*al.tokens(texts))
    parts = [al.links(*al.tokens([t])) for t in texts]
    assert whole["pair"].to_pylist() == [x for p in parts for x in p["pair"].to_pylist()]
