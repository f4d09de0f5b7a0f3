import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect_and_end_in_whole_documents(spark, tmp_path):
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, prose(60), "en", f"s{i % 3}") for i in range(150)]
    rows += [(1000, rows[0][1], "en", "s0"), (1001, rows[1][1].upper(), "en", "s1"), (1002, "short", "en", "s0"), (1003, "again and again now ok " * 40, "en", "s2"), (1004, None, None, None), *((None, prose(50), None, "s1") for _ in range(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("key", "row", "sha", "w", "p", "n", "topic", "_row", "ids")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        at.append(stage(spark, at[-1], str(tmp_path)))
    ids = [{x.doc_id for x in f.select("doc_id").collect()} for f in at]
    assert ids[1] == ids[0] - {1002, 1003, 1004}
    assert ids[2] == ids[1] - {0, 1}
    nulls = [f.filter("doc_id IS NULL").count() for f in at[:4]]
    assert nulls == [3, 3, 3, 3]  # unrelated texts stay apart
    assert all(r.key == "own key" and r._row == "own _row" for r in at[4].collect())
    assert ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    assert all(f.columns == docs.columns for f in at[:-1])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in whole.select("doc_id").collect()} == ids[5]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
