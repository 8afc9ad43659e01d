import hashlib

from roadrisk.llm import exact_dedup as X
from tests.llm import cases


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t, *_ in rows:
        ids = groups[norm(t)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_groups_equal_brute_force(spark):
    assert cases.fields(X.duplicate_groups(cases.documents(spark)), *COLS) == brute(cases.texts())


def test_saturated_filter_is_still_exact(spark):
    got = X.duplicate_groups(cases.documents(spark), max_bits=1 << 6)
    assert cases.fields(got, *COLS) == brute(cases.texts())


def test_one_row_of_each_text_stays(spark):
    docs = cases.documents(spark)
    got = X.exact_dedup(docs)
    assert got.columns == docs.columns
    keep = {(r[1], norm_key(r[4])) for r in brute(cases.texts())}
    assert {(r.doc_id, norm_key(hashlib.sha256(norm(r.text).encode()).hexdigest())) for r in got.collect()} == keep
    assert got.count() == len(keep)


def norm_key(sha):
    return sha[:20]


def test_empty_table(spark):
    docs = cases.documents(spark, [])
    assert X.duplicate_groups(docs).count() == 0 and X.exact_dedup(docs).count() == 0
