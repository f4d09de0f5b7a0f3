"""Concepts: how alike a phrase and the labels of a taxonomy are."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T


def likeness(concept: str, terms: list[str]) -> tuple[float, bool]:
    """0.7 x the best ratio of the concept to a term + 0.3 x the best share of its words that a term has; a ratio is 0.95 at least where
    one stands in the other. And whether any term has it, or a word of it. All in the form of T.concept_key."""
    if not concept:
        return 0.0, False
    words, best, shared, matched = set(concept.split()), 0.0, 0.0, False
    for term in filter(None, terms):
        ratio = SequenceMatcher(None, concept, term).ratio()
        inside = concept in term or term in concept
        common = len(words & set(term.split())) / max(1, len(words))
        best, shared = max(best, ratio, 0.95 if inside else 0.0), max(shared, common)
        matched |= inside or common > 0
    return round(0.7 * best + 0.3 * shared, 4), matched


def matched_concepts(concepts: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """concept_id, id, score, fit, confidence, rank: the k labels most like each concept, of equals the least id.

    concepts: concept_id, concept, a stated set; labels: id, label, terms, a taxonomy's list. Each concept meets each label; Spark
    deals the pairs out, and a task holds one batch of them.
    """

    @F.pandas_udf("struct<score:double,matched:boolean>")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for said, terms in parts:
            yield pd.DataFrame([likeness(c, list(t)) for c, t in zip(said, terms)], columns=["score", "matched"])

    left = concepts.select("concept_id", T.concept_key(F.col("concept")).alias("said"))
    right = labels.select("id", T.concept_key(F.col("label")).alias("label"), F.transform("terms", T.concept_key).alias("terms"))
    rows = left.crossJoin(right).withColumn("s", score("said", "terms"))
    fit = T.fit(F.col("said"), F.col("label"), F.col("s.score"), F.col("s.matched"))
    rank = F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("score"), "id"))
    made = rows.select("concept_id", "id", F.col("s.score").alias("score"), fit.alias("fit"), T.confidence(F.col("s.score")).alias("confidence"))
    return made.withColumn("rank", rank).filter(F.col("rank") <= k)
