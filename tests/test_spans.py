"""Merged spans on odd rows, against their SQL."""

import pytest

duckdb = pytest.importorskip("duckdb")
from folioforge.plans import registry  # noqa: E402

ROWS = [(1, 1, 3.0), (1, 1, None), (1, 4, 2.5), (1, 4, 3.5), (2, None, 5.0), (2, 2, 4.6), (2, 2, None), (3, 1, None), (3, 1, None), (None, 1, 9.5), (None, 3, 1.0)]


def test_missing_and_broken_numbers_equal_sql(spark, tmp_path):
    """A missing end comes last and opens no span of its own; a broken number of a length is rounded to even, not cut."""
    spark.createDataFrame(ROWS, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()["R1_merged_spans"]).fetchall()
    got = [tuple(r) for r in registry.queries()["R1_merged_spans"](spark, str(tmp_path)).select("k", "start", "stop").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
