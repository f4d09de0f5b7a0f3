"""Each query with SQL against DuckDB on the smallest tables."""

from collections import Counter

import pytest

from folioforge.llm import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    frame = queries.QUERIES[name](spark, FOLDER)
    plain = lambda rows: Counter(tuple(float(f"{v:.8g}") if isinstance(v, float) else v for v in r) for r in rows)
    cursor = con.execute(queries.SQL[name])
    places = [[d[0] for d in cursor.description].index(c) for c in frame.columns]
    assert len(places) == len(cursor.description)
    assert plain(map(tuple, frame.collect())) == plain(tuple(r[i] for i in places) for r in cursor.fetchall())
