"""Maximal phrases against plain code that takes phrases one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.operators import phrases as P


def inside(short, long):
    return len(short.split()) < len(long.split()) and f" {short} " in f" {long} "


def plain_top(texts, least, most, least_docs, k):
    docs, times, first = {}, Counter(), {}
    for d, words in texts:
        for n in range(least, most + 1):
            for i in range(len(words) - n + 1):
                run = words[i : i + n]
                if run[0] not in P.STOPS and run[-1] not in P.STOPS:
                    p = " ".join(run)
                    docs.setdefault(p, set()).add(d)
                    times[p] += 1
                    first.setdefault(p, (d, i))
    found = [p for p in docs if len(docs[p]) >= least_docs]
    found.sort(key=lambda p: (-len(docs[p]), -len(p.split()), -times[p], first[p]))
    kept = []
    for p in found:
        if not any(inside(p, q) and len(docs[q]) == len(docs[p]) for q in kept):
            kept.append(p)
    return [(p, len(docs[p]), times[p]) for p in kept[:k]]


@pytest.mark.parametrize("seed", range(3))
def test_top_phrases_equal_plain_code(spark, seed):
    r = random.Random(seed)
    common = [[r.choice("a b the of to c d e".split()) for _ in range(9)] for _ in range(3)]
    texts = [(d, [w for _ in range(r.randint(0, 3)) for w in r.choice(common)[r.randint(0, 3) :] + [f"w{r.randint(0, 9)}"]]) for d in range(30)] + [(100, [])]
    table = spark.createDataFrame(texts, "doc_id int, words array<string>").repartition(3)
    got = P.top_phrases(table, least=2, most=5, k=25).orderBy("rank").collect()
    assert [(x.phrase, x.docs, x.occurrences) for x in got] == plain_top(texts, 2, 5, 2, 25) and [x["rank"] for x in got] == list(range(1, len(got) + 1))


def plain_collapse(ranked, k):
    kept = []
    for p in ranked:
        kept = [q for q in kept if not inside(q, p)]
        if any(inside(p, q) for q in kept):
            continue
        kept.append(p)
        if len(kept) >= k:
            break
    return kept


@pytest.mark.parametrize("k", [1, 3, 8, 1000])
def test_collapse_equals_one_by_one(spark, k):
    r = random.Random(k)
    sides = {}
    for side in "xy":
        text = [r.choice("abc") for _ in range(60)]
        found = {" ".join(text[i : i + n]) for n in range(2, 6) for i in r.sample(range(55), 12)}
        sides[side] = r.sample(sorted(found), len(found))
    rows = [(s, i + 1, p.split()) for s, ranked in sides.items() for i, p in enumerate(ranked)]
    table = spark.createDataFrame(rows, "side string, rank int, phrase array<string>").withColumns({"a": F.xxhash64("phrase"), "b": F.xxhash64(F.lit(1), "phrase")})
    got = P.collapsed(table, ["side"], 2, 5, k).orderBy("rank").collect()
    for side, ranked in sides.items():
        assert [" ".join(x.phrase) for x in got if x.side == side] == plain_collapse(ranked, k)


def test_shapes(spark):
    shares = {"steady increase": (0.1, 0.2, 0.16, 0.3, 0.4), "steady decrease": (0.4, 0.3, 0.3, 0.34, 0.1), "late jump": (0.3, 0.26, 0.28, 0.1, 0.42), "mid-period spike": (0.1, 0.1, 0.5, 0.1, 0.2), "mixed": (0.5, 0.1, 0.3, 0.1, 0.45)}
    shares["late jump"] = (0.3, 0.28, 0.26, 0.22, 0.38)
    rows = [(name, *s) for name, s in shares.items()]
    table = spark.createDataFrame(rows, "name string, s0 double, s1 double, s2 double, s3 double, s4 double")
    got = {x.name: x.shape for x in table.select("name", P.shift_shape([F.col(f"s{i}") for i in range(5)]).alias("shape")).collect()}
    assert got == {name: name for name in shares}


def test_rare_runs_are_never_shuffled(spark, monkeypatch):
    """Of 30,000 different runs only those that could be among the first are counted by their words."""
    r = random.Random(5)
    texts = [(d, [f"u{d}_{i}" for i in range(60)] + ["x", "y", "z", "v"][: 3 + (d % 5 == 0)] + [f"u{d}_{r.random()}"]) for d in range(500)]
    counted, frames = P.counted, []
    monkeypatch.setattr(P, "counted", lambda *a, **k: frames.append(counted(*a, **k)) or frames[-1])
    got = P.top_phrases(spark.createDataFrame(texts, "doc_id int, words array<string>"), k=2).orderBy("rank").collect()
    assert [(x.phrase, x.docs) for x in got] == [("x y z", 500), ("x y z v", 100)]
    assert frames[0].count() < 1000


def test_rows_of_one_id_count_once_and_no_run_goes_across(spark):
    rows = [(1, "a b c d".split()), (1, "b c d e".split()), (2, "b c d".split()), (3, "e b c".split()), (4, None), (5, [])]
    got = P.top_phrases(spark.createDataFrame(rows, "doc_id int, words array<string>"), k=9, stops=()).collect()
    assert [(x.phrase, x.docs, x.occurrences) for x in got] == [("b c d", 2, 3)]


@pytest.mark.parametrize("least_effect", [0.0, 0.3])
def test_shifted_runs_equal_plain_code(spark, least_effect):
    """What moves little or stands in the middle periods alone is as in plain code, and one that moves in one direction is not lost."""
    r = random.Random(7)
    lines = [[r.choice("abcdefgh") for _ in range(6)] for _ in range(4)]
    texts = [(d, d % 4, [w for _ in range(2) for w in lines[r.randint(0, 3) if d % 4 else r.randint(0, 1)]] + [f"w{d}"]) for d in range(80)]
    found = {}
    for d, p, words in texts:
        for n in range(2, 6):
            for i in range(len(words) - n + 1):
                found.setdefault(" ".join(words[i : i + n]), [set() for _ in range(4)])[p].add(d)
    want = {}
    for phrase, docs in found.items():
        shares = [len(x) / 20 for x in docs]
        if max(map(len, docs)) >= 3 and max(shares) >= 0.05 and abs(shares[3] - shares[0]) >= least_effect:
            want[phrase] = shares
    table = spark.createDataFrame(texts, "doc_id int, p int, words array<string>").repartition(3)
    got = P.shifted_phrases(table, "p", range(4), lambda t: F.lit(False), least=2, most=5, k=10**6, least_docs=3, least_effect=least_effect)
    longest = {p for p in want if not any(inside(p, q) for q in want)}
    rows = [x for x in got.collect() if x.direction == "addition"]
    assert {x.phrase: (x.share_0, x.share_1, x.share_2, x.share_3) for x in rows} == {p: tuple(want[p]) for p in longest}
