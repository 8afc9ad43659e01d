import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadrisk.llm import substring_dedup as sd
from tests.conftest import SF
from tests.llm import cases

FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + bytes(gone), gone))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, length, **columns):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(columns).repartition(3)
    got = sorted((tuple(r[f] for f in FIELDS) for r in sd.removal_digests(df, length).collect()), key=repr)
    assert got == brute(rows, length)
    return got


@settings(max_examples=200, deadline=None)
@given(st.integers(24, 60), st.integers(1, 4), st.integers(0, 10**6), st.integers(1, 5))
def test_each_start_is_told_once_and_alike(length, alphabet, seed, n):
    """Every start belongs to one phrase, and equal strings get the same distance to their trigger."""
    rng = random.Random(seed)
    shape = sd.Shape(length)
    piece = bytes(rng.choice(b"abcd"[:alphabet]) for _ in range(150))
    texts = [bytes(rng.choice(b"abcd"[:alphabet]) for _ in range(rng.randrange(80))) + piece[rng.randrange(60):][:rng.randrange(150)] for _ in range(n)] + [b""]
    data = b"".join(texts)
    begins = np.cumsum([0, *map(len, texts)])
    told = {}
    for d, g, m in sd._phrases(data, np.array([len(t) for t in texts]), shape).tolist():
        for s in range(g - max(m, 1) + 1, g + 1):
            if s + length <= begins[d + 1]:
                assert s >= begins[d] and s not in told
                told[s] = (g - s, m > 0)
    assert len(told) == sum(max(0, len(t) - length + 1) for t in texts)
    by_string = {}
    for s, how in told.items():
        assert by_string.setdefault(data[s:s + length], how) == how


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 12))
def test_starts_of_a_share(seed, n):
    rng = random.Random(seed)
    left = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(8))) for _ in range(n)]
    right = [bytes(rng.choice(b"a\0") for _ in range(rng.randrange(2, 11))) for _ in range(n)]
    rows = list(dict.fromkeys(zip(left, right)))
    got = sd.repeated_starts([a for a, _ in rows], [b for _, b in rows], 10)
    for d in range(got.shape[1]):
        strings = [(a[len(a) - d:] + b)[:10] if len(a) >= d and len(b) >= 10 - d else None for a, b in rows]
        assert got[:, d].tolist() == [s is not None and strings.count(s) > 1 for s in strings]


def edited(seed=5, base=1500, docs=40):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcdefgh éß\n") for _ in range(base))
    out = []
    for _ in range(docs):
        t = text
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "X", "日本", t[:rng.randrange(300)]]) + t[i + rng.randrange(30):]
        out.append(t[rng.randrange(200):])
    return out


@pytest.mark.parametrize("length", [40, 128])
@pytest.mark.parametrize("hot", [512, 2])
def test_edited_copies(spark, monkeypatch, length, hot):
    monkeypatch.setattr(sd.repeated_spans, "__defaults__", (hot,))
    rows = list(enumerate(edited()))
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(length + 30))
    rows += [(100 + i, "".join(rng.choice("qrstuvwxyz") for _ in range(rng.randrange(90))) + passage + str(i) * 20) for i in range(60)]
    check(spark, rows, length)


def test_awkward_texts(spark):
    from pyspark.sql import functions as F
    rows = [(r[0], r[1]) for r in cases.texts()]
    rows += [(300, "a" * 3000), (301, "ab" * 700), (302, "a" * 410 + "b"), (303, "a" * 400), (304, "a" * 399), (None, "xyz" * 300), (None, "xyz" * 300),
             (305, "\0" * 900), (306, "é" * 500), (307, "ab" * 250)]
    got = check(spark, rows, 400, id=F.lit("i"), th=F.lit(1), spans=F.lit(2), key=F.lit(3), place=F.lit("p"))
    assert sum(r[2] > 0 for r in got) > 10


def test_spans_and_kept_bytes(spark):
    rows = [(1, "x" * 7 + "".join(map(str, range(400)))), (2, "".join(map(str, range(400)))), (3, "short")]
    got = {r.doc_id: r for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()}
    size = len(rows[1][1])
    assert got[1].spans == [[7, 7 + size]] and bytes(got[1].kept) == b"x" * 7 and got[2].spans == [[0, size]] and bytes(got[3].kept) == b"short"


def test_empty_table(spark):
    assert check(spark, [], 400) == []


def test_given_documents(spark):
    import pyarrow.parquet as pq
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = check(spark, rows, 400)
    assert any(r[2] for r in got)
