"""Queries see files that are added between two calls of one session."""

import shutil

import __spark_entry__ as E
from tests.conftest import SF


def test_new_files_are_seen(spark, tmp_path):
    for t in ("orders", "lineitem", "customer"):
        (tmp_path / f"{t}.parquet").mkdir()
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet" / "part-0.parquet")
    q = E.queries()["value_counts_claims"]
    first = sum(r["trips"] for r in q(spark, str(tmp_path)).collect())
    shifted = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey + 100000000 AS o_orderkey", "* EXCEPT (o_orderkey)")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey + 100000000 AS l_orderkey", "* EXCEPT (l_orderkey)")
    shifted.write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    lines.write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert sum(r["trips"] for r in q(spark, str(tmp_path)).collect()) == 2 * first
