"""Slots for models that are trained elsewhere: named functions of batches, applied to columns of a table.

A page classifier, a tagger, a taxonomy predictor, an exhibit model or an embedder is a Python function from pandas columns to a
pandas column. It is registered under a name with its result's type and loaded once for each Python worker; queries name the slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What a slot's function gives: page classes with probabilities, tagged text, label ids, a probability, a vector.
KINDS = {
    "page_classifier": "array<struct<label:string,probability:double>>",
    "tagger": "string",
    "taxonomy": "array<string>",
    "exhibit": "double",
    "embedder": "array<double>",
}
Predict = Callable[..., pd.Series]


def slot(load: Callable[[], Predict], kind: str) -> Callable[..., Column]:
    """A column function from a model's loader, which runs once for each task; kind: one of KINDS, or a type."""

    @F.pandas_udf(KINDS.get(kind, kind))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        predict = load()
        for columns in batches:
            yield predict(*(columns if isinstance(columns, tuple) else (columns,)))

    return run


def register(spark: SparkSession, name: str, load: Callable[[], Predict], kind: str) -> Callable[..., Column]:
    """The slot as a function of SQL as well."""
    made = slot(load, kind)
    spark.udf.register(name, made)
    return made
