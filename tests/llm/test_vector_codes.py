import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadrisk.llm import vector_codes as vc
from tests.conftest import SF


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 4), st.integers(1, 60), st.integers(0, 9999), st.integers(1, 17), st.integers(1, 30))
def test_trees_assign_as_plain_comparison(n, d, spread, seed, k, leaf):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread, (n, d)) + rng.integers(-3, 4, (n, 1)) * 100
    t = vc.cover_tree(points, leaf)
    assert sorted(t.order.tolist()) == list(range(n))
    place = np.argsort(t.order)
    for x in range(len(t.start)):
        mine = points[t.order[t.start[x]:t.end[x]]]
        assert len(mine) and np.sqrt(((mine - points[t.centre[x]]) ** 2).sum(1)).max() == pytest.approx(t.radius[x])
        kids = range(t.first[x], t.last[x])
        if len(kids):
            assert [t.start[c] for c in kids] == [t.start[x], *[t.end[c] for c in kids][:-1]] and t.end[kids[-1]] == t.end[x]
            scale = 2.0 ** math.ceil(math.log2(t.radius[x])) / 2
            centres = points[[t.centre[c] for c in kids]]
            assert all(t.radius[c] <= scale + 1e-9 for c in kids)
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(len(kids), 1)]
            assert (gaps > scale - 1e-9).all()
    book = points[rng.integers(0, n, k)] + rng.integers(-2, 3, (k, d))
    w = vc.Walk(points[t.order], t.start, t.end, place[t.centre], t.radius, t.first, t.last)
    entry, miss = w.assigned(book)
    dist = ((points[t.order][:, None] - book[None]) ** 2).sum(2)
    assert (entry == dist.argmin(1)).all() and (miss == dist.min(1)).all()
    count, total = w.totals(book)
    for e in range(k):
        assert count[e] == (entry == e).sum() and (total[e] == points[t.order][entry == e].sum(0)).all()


def test_clustered_points_settle_as_subtrees():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.integers(-4000, 4000, (12, 8)), 500, 0) + rng.integers(-5, 6, (6000, 8))
    t = vc.cover_tree(points)
    w = vc.Walk(points[t.order], t.start, t.end, np.argsort(t.order)[t.centre], t.radius, t.first, t.last)
    assert len(w.settle(points[::500])[1]) == 0


def brute(rows, parts=8, entries=16, rounds=6):
    keep = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(keep[0][2])
    good = [r for r in keep if len(r[2]) == size]
    x = np.array([r[2] for r in good]).reshape(len(good), parts, -1)
    books = [x[:entries, j].copy() for j in range(parts)]
    pick = lambda: [((x[:, j][:, None] - books[j][None]) ** 2).sum(2).argmin(1) for j in range(parts)]
    for _ in range(rounds):
        for j, a in enumerate(pick()):
            for e in range(len(books[j])):
                if (a == e).any():
                    books[j][e] = x[a == e, j].sum(0) // (a == e).sum()
    final = pick()
    error = sum(((x[:, j] - books[j][final[j]]) ** 2).sum(1) for j in range(parts))
    code = ["".join(f"{final[j][i]:02x}" for j in range(parts)) for i in range(len(good))]
    by_label: dict = {}
    for r, e in zip(good, error):
        by_label[r[1]] = by_label.get(r[1], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    out = [(r[0], c, int(e), by_label[r[1]], sha) for r, c, e in zip(good, code, error)]
    return out + [(r[0], None, None, by_label.get(r[1]), sha) for r in keep if len(r[2]) != size]


FIELDS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def compare(spark, rows, **columns):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r[f] for f in FIELDS) for r in vc.vector_codes(df.withColumns(columns).repartition(3)).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_awkward_vectors(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(2)
    vec = lambda: [float(x) for x in np.round(rng.normal(size=16), 3)]
    same = vec()
    rows = [(i, vec(), int(rng.integers(0, 3))) for i in range(80)]
    rows += [(200 + i, same, 1) for i in range(150)]  # one value holds most rows
    rows += [(5, vec(), None), (5, vec(), None), (None, vec(), 2), (300, None, 1), (301, [float("nan")] * 16, 1),
             (302, [None] * 16, 1), (303, [float("inf")] * 16, 1), (304, [1.0] * 8, 1), (305, [], 7), (306, [0.0] * 16, None),
             (307, [-1e-9] * 16, 1)]
    compare(spark, rows, part=F.lit("x"), code=F.lit(1), points=F.lit(2), ints=F.lit(3), error=F.lit(4))


def test_fewer_vectors_than_entries_and_none(spark):
    compare(spark, [(3, [1.0] * 8, 1), (1, [2.0] * 8, 1), (2, [2.0] * 8, None)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vc.vector_codes(empty).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int")
    assert [r.code for r in vc.vector_codes(odd).collect()] == [None]


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="is not below"):
        vc.vector_codes(df).collect()


def test_given_embeddings(spark):
    import pyarrow.parquet as pq
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = [tuple(r[f] for f in FIELDS) for r in vc.vector_codes(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
