"""Each query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import pytest

duckdb = pytest.importorskip("duckdb")
from folioforge.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, connection, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=repr)
    relation = connection.sql(registry.oracle_sql()[name])
    order = [list(relation.columns).index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert mine == sorted(([plain(r[i]) for i in order] for r in relation.fetchall()), key=repr)
