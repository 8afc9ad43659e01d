"""Every registered query runs at sf0.001; SQL-expressible ones match DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from roadrisk.plans import catalog
from tests.conftest import SF

catalog.load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool):
        return str(int(v))
    return "None" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s = sorted("|".join(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    d = sorted("|".join(_norm(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert s == d


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_stream_score_equals_batch(spark):
    q = E.queries()
    a = q["stream_score"](spark, SF).select("trip_id", "risk_score", "risk_category")
    b = q["predictions"](spark, SF).select("trip_id", "risk_score", "risk_category")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
