"""Exhibit features in plain strings against those in columns, and the classifier's passes over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import exhibits as X


def test_numbers_equal_columns(spark):
    r = random.Random(3)
    parts = [*X.SUBJECT, *X.TITLES, *X.AGAINST, "Mac", "go shop", "GO-SHOP", "x1", "\u2003", "\u212a", "\u0130stanbul", "\u03a3\u03a3", "\n\t", ", ", "--", "co-operation agreement", "AMENDMENT AMENDMENT", "Subscription  agreements"]
    texts = ["", None, " ", "merger", "a merger agreement", "\u00e9 MERGER", "x" * 1990 + " merger agreement option", " ." * 1500 + "option"]
    texts += ["".join(r.choice([str.upper, str.lower, str.title, str])(r.choice(parts)) + r.choice(["", " ", "  ", "-", "\n"]) for _ in range(r.randint(1, 90))) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in X.featured(table).select("text", *X.FEATURES).collect():
        assert X.numbers(row.text) == pytest.approx(tuple(row)[1:]), row.text


def test_texts_are_hashed_once_for_the_whole_fit(spark, tmp_path):
    """Each step of the fit went through the texts again, some four times in all."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, ("merger closing " if i % 2 else "loan lender ") * (1 + i % 4) + f"w{i}", i % 2) for i in range(40)], "id long, text string, label int")
    model, like = X.fit(rows.mapInArrow(look, rows.schema), "id")
    # once to count the labels, once for the sample of the likeness, once for all that is hashed
    assert seen.value <= 3 * 40
    found = X.predict((model, like), rows.withColumn("label", F.lit(None)), "id", short=1).collect()
    assert [x.positive for x in sorted(found, key=lambda x: x.id)] == [bool(i % 2) for i in range(40)]
