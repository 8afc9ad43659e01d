import math

import numpy as np
import pytest

from roadrisk.llm import embedding_dedup as D
from tests.conftest import SF
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, row int"


def brute(rows, cosine=0.93):
    def unit(v, label):
        if label is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array([np.float32(x) for x in v], dtype=np.float64)
        return a / np.linalg.norm(a)

    us = [unit(v, label) for _, v, label, *_ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)
             if us[i] is not None and us[j] is not None and rows[i][2] == rows[j][2] and len(us[i]) == len(us[j]) and us[i] @ us[j] >= cosine]
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    root = cases.components(len(rows), pairs)
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return sorted((r[0], n[i], low[root[i]], r[0] == low[root[i]]) for i, r in enumerate(rows))


def near_rows(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(30):
        centre = rng.standard_normal(dim)
        # the spread decides whether a group is one ball, several, or a chain
        for _ in range(int(rng.integers(1, 25))):
            rows.append((k, (centre + rng.standard_normal(dim) * [0.05, 0.2, 0.3][g % 3]).tolist(), g % 4))
            k += 1
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] + [1.0] * (dim - 1), [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1e-38] * dim, [3e38] * dim,
           [1.0] * dim, [1.0] * (dim + 1)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, [1.0] * dim, None), (2001, [1.0] * dim, 2), (2001, [1.0] * dim, 2)]
    return [(*r, "x", 1) for r in rows]


def test_equals_brute_force_on_a_small_table(spark):
    rows = near_rows()
    got = D.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)


def test_recall_on_the_given_table(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in t])
    got = D.near_duplicate_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    found, true = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found <= true and found >= 0.9 * true


def test_small_windows_miss_links_but_make_none(spark):
    rows = near_rows(1)
    got = D.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), passes=1, window=4)
    want = {}
    for w in brute(rows):
        want.setdefault(w[0], []).append(w[1])
    assert all(r.n_links <= max(want[r.vec_id]) for r in got.collect())


def planted_pairs(n, dim=64, cosine=0.932, seed=5):
    """2 n vectors of one label: each of n random directions with one at ``cosine`` to it."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((n, dim))
    y -= (x * y).sum(1)[:, None] * x
    y *= math.sqrt(1 - cosine ** 2) / np.linalg.norm(y, axis=1)[:, None]
    both = np.concatenate([x, cosine * x + y])
    return [(i, v.tolist(), 1, "x", 1) for i, v in enumerate(both)]


def test_passes_grow_with_the_leaders_of_a_label(spark):
    n = 2000
    df = spark.createDataFrame(planted_pairs(n), SCHEMA).repartition(3)
    # 250 windows: two passes don't do
    got = D.near_duplicate_vectors(df, passes=2, window=16).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * 2 * n <= got <= 2 * n


def test_partitions_do_not_cut_windows(spark):
    n = 1000
    df = spark.createDataFrame(planted_pairs(n), SCHEMA).repartition(3)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 50):  # 50: ranges of some 40 rows, less than a window
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(D.near_duplicate_vectors(df, window=64).agg({"n_links": "sum"}).first()[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] >= 0.97 * 2 * n


def test_a_label_within_one_window_is_compared_whole(spark):
    rows = planted_pairs(250)
    got = D.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), passes=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def crowded(n, crowds, between=0.88, cosine=0.935, dim=64, seed=9):
    """2 n vectors of one label round ``crowds`` directions, those of one crowd at
    some ``between`` to each other; n of them have a partner at ``cosine``."""
    rng = np.random.default_rng(seed)

    def off(x):  # a random direction across x
        y = rng.standard_normal(x.shape)
        y -= (x * y).sum(1)[:, None] * x
        return y / np.linalg.norm(y, axis=1)[:, None]

    axes = rng.standard_normal((crowds, dim))
    axes = (axes / np.linalg.norm(axes, axis=1)[:, None])[rng.integers(0, crowds, n)]
    x = math.sqrt(between) * axes + math.sqrt(1 - between) * off(axes)
    both = np.concatenate([x, cosine * x + math.sqrt(1 - cosine ** 2) * off(x)])
    return both, [(i, v.tolist(), 1, "x", 1) for i, v in enumerate(both)]


@pytest.mark.parametrize("crowds", [1, 12])
def test_crowded_labels_keep_their_links(spark, crowds):
    x, rows = crowded(3000, crowds)
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = int((x @ x.T >= 0.93).sum()) - len(x)
    got = D.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), window=64).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * true <= got <= true


def test_windows_grow_to_the_whole_label(spark):
    # one crowd: no number of passes is cheaper than the label itself, in blocks of 32 rows
    x, rows = crowded(300, 1)
    got = D.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), window=4, passes=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("schema", [SCHEMA])
def test_empty_table(spark, schema):
    assert D.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
