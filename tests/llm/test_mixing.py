import math

import pytest

from folioforge.llm import mixing

duckdb = pytest.importorskip("duckdb")


def corpus(spark, n=2000):
    # source, language and topic vary on their own, so that all marginals can be met at once
    said = ["mountains ", "harbours ", "gardening ", "x "]
    rows = [(i, "word " * (5 + i % 7) + said[i // 15 % 4] + said[i // 30 % 3] * (i % 2), "hot" if i % 3 else f"s{i % 5}", ["en", "de", None][i * 7919 % 97 % 3], 1.0) for i in range(n)]
    rows += [(None, None, None, None, None), (5, "", "empty", "en", None), (5, "", "empty", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, w double")


@pytest.fixture(autouse=True)
def widespread(monkeypatch):
    monkeypatch.setattr(mixing, "WIDEST", 0.6)


def plain_topics(texts):
    """Topics as they are written down."""
    import re

    said = [[w[: mixing.STEM] for w in re.findall(mixing.LONG_WORDS, (t or "").lower())] for t in texts]
    n = {}
    for s in said:
        for x in set(s):
            n[x] = n.get(x, 0) + 1
    names = sorted((x for x in n if 1 < n[x] <= mixing.WIDEST * len(texts)), key=lambda x: (-n[x], x))[: mixing.TOPICS]
    return names, [max(names, key=lambda x, s=s: (s.count(x), -names.index(x))) if set(s) & set(names) else mixing.OTHER for s in said]


def test_topics_equal_plain_ones(spark):
    docs = corpus(spark, 300)
    rows = docs.collect()
    names, wanted = plain_topics([r.text for r in rows])
    assert mixing.find_topics(docs) == names and len(names) == 3
    got = mixing.described(docs, names, mixing.quoted("doc_id")).collect()
    assert sorted((r.doc_id or -1, r.topic) for r in got) == sorted((r.doc_id or -1, t) for r, t in zip(rows, wanted))


def test_weights_meet_the_marginals_and_the_budget(spark):
    docs = corpus(spark)
    cells = mixing.raked(mixing.cells_of(mixing.described(docs, mixing.find_topics(docs))), mixing.TEMPER, 30)
    rows = cells.collect()
    assert abs(sum(r.w for r in rows) - 1) < 1e-9 and max(r.e for r in rows) < mixing.TOLERANCE
    for name in mixing.TEMPER:
        shares, targets = {}, {}
        for r in rows:
            shares[r[name]] = shares.get(r[name], 0) + r.w
            targets[r[name]] = r[f"t_{name}"]
        assert all(abs(shares[k] - targets[k]) < 1e-4 for k in shares)
    solved = mixing.calibrated(cells, 0.6).collect()
    total = sum(r.t for r in solved)
    assert all(0 <= r.p <= 1 for r in solved) and abs(sum(r.p * r.t for r in solved) / total - 0.6) < 0.01
    report = mixing.marginals(docs).collect()
    assert len(report) == sum(len({r[c] for r in rows}) for c in mixing.TEMPER) and max(abs(r.error) for r in report) < 1e-4


def test_sample_is_stable_and_near_its_probability(spark):
    docs = corpus(spark)
    report = mixing.mix_report(docs).collect()
    assert len(report) == docs.count()
    kept = mixing.sample(docs.repartition(5))
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in report)
    tokens = sum(r.n_tokens for r in report)
    assert abs(sum(r.n_tokens for r in report if r.sampled) / tokens - mixing.BUDGET) < 0.05
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_report_equals_sql(spark):
    docs = corpus(spark, 400)
    documents = docs.toPandas()  # noqa: F841
    plain = lambda rows: sorted(([round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r] for r in rows), key=repr)
    got = mixing.mix_report(docs)
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    assert plain(map(tuple, got.collect())) == plain(duckdb.sql(mixing.sql()).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
