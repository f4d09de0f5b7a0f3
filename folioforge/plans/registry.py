"""All registered queries of the reference's own operators, with the SQL they are held against.

A query is registered under the identifier of its operator in the survey, then a name. A query without SQL is tested against a
plain version in tests/.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("filters", "joins", "rollups", "sequences", "search", "texts", "documents", "retrieval", "phrases", "pages", "outline", "duplicates", "states", "sources")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on demand with pushdown left to the reader."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of the tables."""

    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__doc__, run.__name__ = build.__doc__, name
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"folioforge.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["A7_deal_size_quantiles"](spark, folder)
