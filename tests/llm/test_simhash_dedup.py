import random

import xxhash
from pyspark.sql import functions as F

from roadrisk.llm import simhash_dedup as S
from tests.llm import cases


def fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, distance=4):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance]
    root = cases.components(len(fps), pairs)
    low = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return [low.get(r) for r in root]


def unsigned(x):
    return x + (1 << 64) if x < 0 else x


def test_components_equal_brute_force(spark):
    rows = cases.texts()
    fps = [fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute(fps, [r[0] for r in rows])), key=repr)
    got = S.near_duplicate_components(cases.documents(spark))
    assert sorted(((r.doc_id, unsigned(r.fp), r.component_id) for r in got.collect()), key=repr) == want


def test_links_find_every_pair(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)}
                 | {rng.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    plan = S.plan_partitions(nodes, 4)
    assert sum(t + 1 for _, t in plan) >= 1 and all(t >= 0 for _, t in plan)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4}
    # whatever the thresholds are, as long as they share out the distance
    groups = S.group_bits(*S.bit_moments(nodes), 4)
    for p in (plan, list(zip(groups, [1, 0, 0, 0])), [(groups[0], 2), (groups[2], 0), (groups[3], 0)]):
        assert {(r.a, r.b) for r in S.links(nodes, p, 4).collect()} == want


def crowds():
    """Crowds round a centre, chains of steps within the distance, strangers: signed fingerprints."""
    rng = random.Random(4)
    flip = lambda f, k: f ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = {rng.getrandbits(64) for _ in range(200)}
    for radius, members in ((1, 60), (2, 400), (3, 200), (5, 100)):
        centre = rng.getrandbits(64)
        fps |= {flip(centre, rng.randint(0, radius)) for _ in range(members)}
    for _ in range(10):
        f = rng.getrandbits(64)
        for _ in range(12):
            f = flip(f, 4)
            fps.add(f)
    return sorted(f - (1 << 64) if f >> 63 else f for f in fps)


def test_roots_equal_brute_force_at_any_thresholds(spark):
    signed = crowds()
    want = brute([f & (2 ** 64 - 1) for f in signed], list(range(len(signed))))
    nodes = spark.createDataFrame([(f, 1 + i % 5) for i, f in enumerate(signed)], "fp long, n long")
    groups = S.group_bits(*S.bit_moments(nodes), 4)
    for p in (S.plan_partitions(nodes, 4), list(zip(groups, [1, 0, 0, 0])), [(groups[0], 2), (groups[2], 0), (groups[3], 0)]):
        root = {r.fp: r.root for r in S.near_roots(nodes, p, 4).collect()}
        assert len(root) == len(signed) and all(r in root for r in root.values())
        low = {}
        for i, f in enumerate(signed):
            low.setdefault(root[f], i)
        assert [low[root[f]] for f in signed] == want


def test_second_links_leave_settled_crowds_alone(spark):
    """A crowd within the distance of its representative costs a row a member, not one a pair."""
    rng = random.Random(6)
    crowd = sorted({sum(1 << b for b in rng.sample(range(63), rng.randint(0, 2))) for _ in range(500)} | {0})
    nodes = spark.createDataFrame([(f, 9 if f == 0 else 1) for f in crowd], "fp long, n long")
    plan = S.plan_partitions(nodes, 4)
    first = S.first_links(nodes, plan, 4)
    assert S.links(nodes, plan, 4).count() == len(crowd) * (len(crowd) - 1) // 2
    assert {f for r in first.collect() for f in (r.a, r.b)} == set(crowd)
    rooted = nodes.select("fp", F.lit(0).cast("long").alias("root"), F.lit(len(crowd)).cast("long").alias("size"))
    assert S.second_links(rooted, plan, 4).count() == 0


def test_allocation_is_the_cheapest():
    import itertools
    rng = random.Random(2)
    for _ in range(20):
        cost = [{t: rng.random() * (t + 2) for t in range(-1, 4)} for _ in range(3)]
        cost = [c | {-1: 0.0} for c in cost]
        got, ts = S.allocate(cost, 2)
        best = min(sum(c[t] for c, t in zip(cost, x)) for x in itertools.product(range(-1, 4), repeat=3) if sum(x) == 2)
        assert abs(got - best) < 1e-12 and sum(ts) == 2


def test_bits_are_all_grouped(spark):
    nodes = spark.range(500).select(F.xxhash64("id").alias("fp"))
    for m in (2, 3, 5):
        groups = S.group_bits(*S.bit_moments(nodes), m)
        assert sorted(b for g in groups for b in g) == list(range(64))


def test_near_dedup_keeps_the_smallest(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["w " * 0 + " ".join(f"w{j}" for j in range(300))] * 3 + ["other words stand here now"])]
    docs = cases.documents(spark, rows)
    got = S.near_dedup(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 3]
    everything = cases.texts()
    fps = [fingerprint(r[1]) for r in everything]
    low = brute(fps, [r[0] for r in everything])
    kept = sorted((r[0] for r, c in zip(everything, low) if r[0] is None or r[0] == c), key=repr)
    assert sorted((r.doc_id for r in S.near_dedup(cases.documents(spark)).collect()), key=repr) == kept


def test_near_dedup_decides_rows_of_one_id_by_their_texts(spark):
    some = lambda c: " ".join(f"{c}{j}" for j in range(300))
    rows = [(0, some("w"), "en", "s", 1), (5, some("w").upper(), "en", "s", 1), (5, some("x"), "en", "s", 1),
            (9, some("y"), "en", "s", 1), (9, some("y") + "  ", "en", "s", 1), (9, some("z"), "en", "s", 1), (10, some("x"), "en", "s", 1)]
    got = sorted((r.doc_id, r.text.strip()) for r in S.near_dedup(cases.documents(spark, rows)).collect())
    assert got == [(0, some("w")), (5, some("x")), (9, some("y")), (9, some("z"))]


def test_empty_table(spark):
    docs = cases.documents(spark, [])
    assert S.near_duplicate_components(docs).count() == 0 and S.near_dedup(docs).count() == 0
