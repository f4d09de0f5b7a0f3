"""Spans of text, [start, stop)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, key: str, gap: int = 0) -> DataFrame:
    """key, start, stop: spans that overlap or lie at most `gap` apart, made one. A span without an end comes after those that start with it."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("stop"))
    reached = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(reached.isNull() | (F.col("start") > reached + gap), 1).otherwise(0))
    runs = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def align(text: str, quote: str, expected: int, reach: int = 128) -> tuple[int, int] | None:
    """Where a quote stands: at the expected place, else the one place nearby, else the one place with white space aside.

    None if there is none; ValueError if several places fit.
    """
    if text[expected : expected + len(quote)] == quote:
        return expected, expected + len(quote)
    low = max(0, expected - reach)
    part = text[low : expected + reach + len(quote)]
    first = part.find(quote)
    if first >= 0:
        if part.find(quote, first + 1) >= 0:
            raise ValueError("several places fit")
        return low + first, low + first + len(quote)
    places = [i for i, c in enumerate(text) if not c.isspace()]
    bare, wanted = "".join(text[i] for i in places), "".join(quote.split())
    first = bare.find(wanted) if wanted else -1
    if first < 0:
        return None
    if bare.find(wanted, first + 1) >= 0:
        raise ValueError("several places fit")
    return places[first], places[first + len(wanted) - 1] + 1


def insert_tags(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with <tag>...</tag> around each span; ValueError if spans overlap or lie outside."""
    out, at = [], 0
    for start, stop, tag in sorted(spans):
        if not at <= start < stop <= len(text):
            raise ValueError("spans overlap or lie outside")
        out += [text[at:start], f"<{tag}>", text[start:stop], f"</{tag}>"]
        at = stop
    return "".join(out) + text[at:]


def aligned(text: str, quote: str, expected: str):
    """align as a column of (start, stop), null where no place fits or several do; the arguments are columns' names."""

    @F.pandas_udf("struct<start:int,stop:int>")
    def run(texts: pd.Series, quotes: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for t, q, e in zip(texts, quotes, places):
            try:
                found = align(t, q, int(e)) if isinstance(t, str) and isinstance(q, str) and q else None
            except ValueError:
                found = None
            out.append(found or (None, None))
        return pd.DataFrame(out, columns=["start", "stop"]).astype("Int32")

    return run(text, quote, expected)


def tagged(text: Column, spans: Column) -> Column:
    """insert_tags as a column, null where spans overlap or lie outside; spans: an array of (start, stop, tag)."""
    ordered = F.array_sort(spans)
    ends = F.transform(ordered, lambda s: s["stop"])
    starts = F.transform(ordered, lambda s: s["start"])
    apart = F.forall(F.sequence(F.lit(1), F.size(ordered)), lambda k: (F.element_at(starts, k) < F.element_at(ends, k)) & ((k == F.size(ordered)) | (F.element_at(ends, k) <= F.coalesce(F.try_element_at(starts, k + 1), F.length(text)))))
    inside = (F.element_at(starts, 1) >= 0) & (F.element_at(ends, -1) <= F.length(text))
    piece = lambda a, b: F.substring(text, a + 1, F.greatest(F.lit(0), b - a))
    parts = F.transform(ordered, lambda s, i: F.concat(piece(F.coalesce(F.get(ends, i - 1), F.lit(0)), s["start"]), F.lit("<"), s["tag"], F.lit(">"), piece(s["start"], s["stop"]), F.lit("</"), s["tag"], F.lit(">")))
    whole = F.concat(F.array_join(parts, ""), piece(F.element_at(ends, -1), F.length(text)))
    return F.when(F.size(ordered) == 0, text).when(apart & inside, whole)
