"""Columns of a table's own that are named like an operator's, and columns of kinds that can't be hashed or compared."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import common, exact_dedup, mixing, quality, similar, simhash

#: Names that operators use for columns of their own.
NAMES = (
    "key _key _row row tie rest _id id _n n _hot _b__p _b_p _w w _p p r e draw h _source _tokens tokens _topic topic t_source cell_weight keep_id kept fp first sha size bands node root least "
    "copies identity group_size component_id bucket rep norm text_sha256 n_words passes none"
).split()


@pytest.fixture
def docs(spark):
    r = random.Random(4)
    prose = [" ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(60)) for _ in range(12)]
    rows = [(i, prose[i % 12], "en" if i % 2 else None, f"s{i % 3}") for i in range(24)] + [(None, prose[0].upper(), "en", "s1"), (None, None, None, None), (3, prose[3], "en", "s0"), (3, prose[3], "en", "s0"), (50, "", "en", "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.withColumns({c: F.lit(f"own {c}") for c in NAMES})
    return frame.withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "d.o`t": F.lit(1.5), "b": F.lit(b"x")})


@pytest.mark.parametrize("share", [2, 1000])
@pytest.mark.parametrize("operator", [quality.keep_good, exact_dedup.drop_duplicates, simhash.drop_near_duplicates, similar.drop_similar, mixing.sample])
def test_rows_keep_all_their_columns(docs, monkeypatch, operator, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    kept = operator(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in NAMES) and all(r["m"] == {"a": 1} and r["d.o`t"] == 1.5 for r in rows)
    keys = [(r.doc_id, r.text) for r in rows]
    assert set(keys) <= {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    if operator in (exact_dedup.drop_duplicates, simhash.drop_near_duplicates, similar.drop_similar):
        assert len({(t or "").lower() for _, t in keys}) == len(keys) == 13


def test_the_row_that_stays_of_equal_ids_and_texts_is_the_same_each_time(spark):
    rows = [(1, "Same Text here", x) for x in ("b", "a", None, "c")] + [(1, "same text here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(exact_dedup.drop_duplicates(docs.repartition(k)).collect()[0]) for k in (1, 3, 5)}
    assert got == {(1, "Same Text here", "a")}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_root(type("Session", (), {"sparkContext": Context()})())
