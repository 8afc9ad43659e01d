import os

import pytest

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm import cases
from tests.llm.test_exact_dedup import norm
from tests.llm.test_simhash_dedup import brute, fingerprint


def test_stages_are_as_dealt():
    assert [n for n, _ in C.STAGES] == ["quality", "exact", "near", "mix", "pack"]


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert sorted(docs.dtypes) == sorted(before.dtypes)
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    quality = {r.doc_id: r.text for r in seen["quality"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.doc_id for r in start if labels.get(r.doc_id) == 1]
    assert sum(d in quality for d in good) > 0.97 * len(good)
    best = {}
    for d, t in quality.items():
        best[norm(t)] = max(best.get(norm(t), d), d)
    exact = sorted(r.doc_id for r in seen["exact"].collect())
    assert exact == sorted(best.values())
    low = brute([fingerprint(quality[d]) for d in exact], exact)
    assert sorted(r.doc_id for r in seen["near"].collect()) == sorted(set(low))
    assert {r.doc_id for r in seen["mix"].collect()} <= set(low)
    bins = {}
    for r in seen["pack"].collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, name):
    stage = dict(C.STAGES)[name]
    for rows in (cases.texts(), []):
        docs = cases.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
        got = stage(spark, docs, SF)
        assert got.count() >= 0 if rows else got.count() == 0
        if name != "pack":
            assert sorted(got.columns) == sorted(docs.columns)


def test_run_is_the_stages_in_a_row(spark):
    got = C.run(spark, SF)
    assert got.columns[:4] == ["doc_id", "piece", "start", "length"] and got.count() > 100 and os.path.isdir(SF)
