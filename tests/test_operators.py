"""Operators that SQL does not express, against plain versions."""

import datetime
import hashlib
import hmac
import random
import uuid
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import spans
from folioforge.functions import text as T
from folioforge.operators import documents as D
from folioforge.operators import near_duplicates as N
from folioforge.operators import retrieval as R
from folioforge.operators import concepts, exhibits, repairs, rollups, search, sequence, sets, slots, states
from folioforge.sources import readers, sinks
from folioforge.streaming import usage


def test_monotone_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    for _ in range(30):
        scores = r.integers(0, 5, (5, 3)).astype(float)
        best = max(sum(scores[t, k] for t, k in enumerate(p)) for p in product(range(3), repeat=5) if list(p) == sorted(p))
        path = sequence.monotone_viterbi(scores)
        assert (np.diff(path) >= 0).all() and sum(scores[t, k] for t, k in enumerate(path)) == best


def test_bootstrap_is_seeded_and_holds_the_mean(spark):
    rows = spark.createDataFrame([("a", float(i % 2)) for i in range(200)] + [("b", 1.0)] * 5 + [("b", None)], "k string, v double")
    out = {r.k: r for r in rollups.bootstrap(rows, "k", "v").collect()}
    again = {r.k: r for r in rollups.bootstrap(rows.repartition(3), "k", "v").collect()}
    assert out == again and out["a"].low < 0.5 < out["a"].high and abs(out["a"].low - 0.43) < 0.02
    assert (out["b"].mean, out["b"].low, out["b"].high) == (1.0, 1.0, 1.0)


def test_uuid5(spark):
    names = ["http://a/b", "ü", "", "x\x1fy"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.uuid5(uuid.NAMESPACE_URL.hex, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_html_pages():
    html = "<head><title>x</title></head><body><p>A&amp;B</p><div style='display: none'>no<p>no</p></div><table><tr><td>1</td><td>2</td></tr></table><hr>next<br>line<p style='page-break-before:always'>last<script>x()</script>"
    assert D.html_pages(html) == ["A&B\n\n1 | 2", "next\nline", "last"]
    assert D.html_pages(None) == [] and D.html_pages("<hr> <hr>") == []


def test_structure_and_violations():
    good = "cover\n" + "\n".join(f"ARTICLE {n} T\nSection {i}.1 A\nbody\nSection {i}.2 B\nbody" for i, n in enumerate(["I", "II", "III", "IV", "V"], 1))
    assert D.structure_violations(D.build_xml(good)) == []
    assert [s["section_order"] for s in D.sections_of(D.build_xml(good))][:2] == [1, 2]
    bad = good.replace("Section 2.2", "Section 3.4").replace("ARTICLE V ", "ARTICLE II ")
    assert D.structure_violations(D.build_xml(bad)) == ["section_article_mismatch", "section_non_sequential", "articles_out_of_order"]
    assert D.structure_violations(None) == ["xml_parse_failure"] and D.structure_violations("<document/>") == ["missing_body"]
    assert D.structure_violations(D.build_xml("")) == ["body_has_no_structural_children"]
    assert D.repair_accepted(["a", "b"], ["a"]) and not D.repair_accepted(["a", "b"], ["c"])


def test_clauses():
    assert [c["anchor"] for c in D.clauses_of(["intro", "(a) one", "more", "(i) sub", "(b) two"])] == ["(a)", "(b)"]
    assert [c["text"] for c in D.clauses_of(["One.", "Two goes", "On here."])] == ["One.", "Two goes\n\nOn here."]
    assert D.clauses_of(None) == []


def test_spans():
    assert spans.align("abc  def", "abc", 0) == (0, 3) and spans.align("xx abc", "abc", 0) == (3, 6) and spans.align("a  b", "a b", 0) == (0, 4)
    assert spans.align("x", "y", 0) is None
    with pytest.raises(ValueError):
        spans.align("zabcabc", "abc", 0)
    assert spans.insert_tags("abcd", [(1, 2, "t"), (3, 4, "u")]) == "a<t>b</t>c<u>d</u>"
    with pytest.raises(ValueError):
        spans.insert_tags("abcd", [(0, 2, "t"), (1, 3, "u")])


def test_minhash_estimates_and_finds_pairs(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:290] + [word() for _ in range(10)])), (2, " ".join(word() for _ in range(300))), (3, ""), (4, None), (5, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = N.signatures(docs)
    found = {(p.a, p.b) for p in N.lsh_candidates(signed, signed).collect()}
    assert {(0, 1), (1, 0)} <= found and all(a != b for a, b in found)
    a, b = (signed.filter(f"doc_id = {k}").select(F.col("minhash").alias(f"m{k}"), F.col("shingle_count").alias(f"n{k}")) for k in (0, 1))
    j, c = N.estimated(F.col("m0"), F.col("m1"), F.col("n0"), F.col("n1"))
    got = a.crossJoin(b).select(j, c).first()
    assert abs(got[0] - 286 / 306) < 0.08 and got[1] > 0.9
    assert {(p.a, p.b) for p in N.similar_pairs(docs).collect()} == {(0, 1)}
    assert {r.doc_id: len(r.minhash) for r in signed.collect()}[3] == 0


def test_count_memo_and_cursors():
    now, made = [0.0], []
    memo = search.CountMemo(10, 2, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert memo.count({"a": 1, "b": 2}, make) == memo.count({"b": 2, "a": 1}, make) == 1
    now[0] = 11
    assert memo.count({"a": 1, "b": 2}, make) == 2
    memo.count({"c": 1}, make), memo.count({"d": 1}, make)
    assert len(memo.held) == 2
    assert search.decode_cursor(search.encode_cursor(None, "k")) == (None, "k")
    with pytest.raises(ValueError):
        search.decode_cursor("?")


def test_keyset_pages_cover_all_rows_in_order(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(40)], "id long, v long")
    for down in (True, False):
        order, seen, last = search.keyset_order("v", "id", down), [], None
        while True:
            part = (rows if last is None else rows.filter(search.keyset_after("v", "id", down, *last))).orderBy(*order).limit(7).collect()
            if not part:
                break
            seen += [r.id for r in part]
            last = (part[-1].v, part[-1].id)
        assert seen == [r.id for r in rows.orderBy(*order).collect()] and len(seen) == 40


def test_hydration_names_a_missing_id(spark):
    ids = spark.createDataFrame([(1, 1), (2, 2)], "k long, ordinal int")
    with pytest.raises(Exception, match="no details for 2"):
        search.hydrate(ids, spark.createDataFrame([(1, "a")], "k long, name string"), "k").collect()


def test_maximal_phrases():
    assert R.maximal_phrases([("a b", 5, 5), ("a b c", 5, 5), ("b", 7, 9)]) == [("b", 7, 9), ("a b c", 5, 5)]


def test_grouped_pairs(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.root for r in sets.grouped(pairs).collect()} == {0, 100}


def test_ledger_resumes(spark, tmp_path):
    ledger, made = states.Ledger(spark, str(tmp_path / "ledger")), []
    assert ledger.resume("r", {"a": lambda: made.append("a")}) == ["a"]
    assert ledger.resume("r", {"a": lambda: made.append("a"), "b": lambda: made.append("b")}) == ["b"] and made == ["a", "b"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, None, "x")], "k long, v string, s string")
    new = spark.createDataFrame([(1, None, "y"), (2, "b", "z"), (3, "c", None)], "k long, v string, s string")
    assert {tuple(r) for r in sinks.merged_keeping(old, new, ["k"], ["s"]).collect()} == {(1, "a", "y"), (2, "b", "x"), (3, "c", None)}
    sinks.dump(spark, {"t": old, "secret": new}, ["t"], str(tmp_path / "dump"))
    assert set(sinks.restore(spark, str(tmp_path / "dump"))) == {"t"}


def test_readers(spark, tmp_path):
    (tmp_path / "form.idx").write_text("Form Type  Company\n-------\nEX-2  Big & Co Inc  123  2020-01-02  edgar/a.txt\n10-K  X  1  2020-01-02  b.txt\n")
    assert [tuple(r) for r in readers.read_index(spark, str(tmp_path / "form.idx"), ["EX-2"]).collect()] == [("EX-2", "Big & Co Inc", "123", "2020-01-02", "edgar/a.txt")]
    with pytest.raises(ValueError, match="b: missing"):
        readers.require(spark.range(1), {"id": "bigint", "b": "string"})
    page = "<table><tr><td>1</td><td><a href=\"/x/ex2.htm\">e</a></td><td>EX-2.1</td></tr><tr><td><a href='/y'>n</a></td><td>EX-99</td></tr></table>"
    assert [r.url for r in readers.index_links(spark.createDataFrame([(page,)], "html string"), "https://h").collect()] == ["https://h/x/ex2.htm"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(2):
        events.filter(F.col("event_id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    usage.stream_hourly(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    key = lambda f: sorted((r.event_type, r.slot, r.n, round(r.total, 2), r.most, tuple(r.buckets)) for r in f.collect())
    assert key(usage.latest(spark, str(tmp_path / "out"))) == key(usage.hourly(events))


def test_pseudonym(spark):
    rows = spark.createDataFrame([(" 1.2.3.4 ",), ("",), (None,)], "ip string")
    got = [r[0] for r in rows.select(usage.pseudonym("ip", "s")).collect()]
    assert got == [hmac.new(b"s", b"1.2.3.4", hashlib.sha256).hexdigest(), None, None]


def test_odd_dates(spark):
    said = ["dated as of June 31, 2021 and dated as of 1 May 202 1", "Dated: March 3, 1980", "DATED AS OF THE 2nd day of July, 2020", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(T.dated_as_of(F.col("t"))).collect()]
    assert got[1:] == [None, datetime.date(2020, 7, 2), None]


def test_lsh_candidates_are_not_chained(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 7, 8]), (3, [1, 2, 3, 9]), (4, [])], "doc_id long, minhash array<bigint>")
    assert {(p.a, p.b) for p in N.lsh_candidates(rows, rows.filter("doc_id = 1"), 2).collect()} == {(1, 2), (1, 3)}


def test_a_band_of_very_many_members_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    rows = spark.createDataFrame([(i, [1, 2, i, i]) for i in range(20)], "doc_id long, minhash array<bigint>")
    assert {(p.a, p.b) for p in N.lsh_candidates(rows, rows.filter("doc_id IN (0, 5)"), 2).collect()} == {(a, b) for a in (0, 5) for b in range(20) if a != b}


def test_lsh_recall_against_all_pairs(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((len(rows), " ".join(words)))
        for share in (0.05, 0.1, 0.25, 0.45, 0.6):
            cut = int(len(words) * share)
            rows.append((len(rows), " ".join([*(word() for _ in range(cut)), *words[cut:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    true = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a != b}
    signed = N.signatures(docs)
    found = {(p.a, p.b) for p in N.lsh_candidates(signed, signed).collect()}
    for least, recall in ((0.8, 1.0), (0.3, 0.98), (0.2, 0.9)):
        wanted = {p for p, j in true.items() if j >= least}
        assert len(wanted & found) >= recall * len(wanted)
    exact = N.overlaps(docs.select("doc_id", T.shingle_hashes(F.col("text")).alias("s")), docs.select("doc_id", T.shingle_hashes(F.col("text")).alias("s"))).filter("a <> b").collect()
    assert {(p.a, p.b): round(p.jaccard, 9) for p in exact} == {p: round(j, 9) for p, j in true.items() if j}


def test_similar_pairs_equal_all_pairs(spark):
    r = random.Random(8)
    words = [r.choice(["aa", "bb", "cc", "dd", "ee"]) + r.choice("xyz") for _ in range(400)]
    rows = [(i, " ".join(words[k : k + n])) for i in range(80) for k, n in [(r.randint(0, 12), r.choice([6, 12, 40, 60]))]]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    least = {}
    for i, t in rows:
        least.setdefault(t, i)
    keep = set(least.values())
    for threshold in (0.5, 0.8):
        true = {(a, b) for a in keep for b in keep if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        assert {(p.a, p.b) for p in N.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()} == true and true


def test_running_sums_and_ntiles_equal_plain_ones(spark):
    r = random.Random(9)
    rows = [(i, r.choice([0, 1, 1, 1, 5, 700, -3]), r.randint(1, 9)) for i in range(301)]
    frame = spark.createDataFrame(rows, "id long, v long, c long").repartition(5)
    for descending in (False, True):
        order = [F.desc("v") if descending else F.asc("v"), F.asc("id")]
        got = {x.id: x.s for x in rollups.running(frame, "v", order, {"s": F.col("c")}, descending, parts=10).collect()}
        total, wanted = 0, {}
        for i, _, c in sorted(rows, key=lambda x: (-x[1] if descending else x[1], x[0])):
            total += c
            wanted[i] = total
        assert got == wanted
    for k in (3, 7, 400):
        got = {x.id: x.q for x in rollups.ntiles(frame, "v", [F.asc("v"), F.asc("id")], k, "q").collect()}
        n, parts = len(rows), []
        for q in range(k):
            parts += [q + 1] * (n // k + (q < n % k))
        assert got == {i: q for (i, _, _), q in zip(sorted(rows, key=lambda x: (x[1], x[0])), parts)}


def test_grouped_equals_union_find(spark):
    r = random.Random(10)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {x.node: x.root for x in sets.grouped(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in {y for a, b in pairs if a != b for y in (a, b)}}


def test_bioes_viterbi_equals_all_paths():
    labels = sequence.bioes_labels(["x", "y"])
    start, stop, follow = sequence.bioes_allowed(labels)
    r = np.random.default_rng(4)
    for n in (1, 2, 4):
        for _ in range(10):
            scores = r.integers(0, 9, (n, len(labels))).astype(float)
            valid = [p for p in product(range(len(labels)), repeat=n) if start[p[0]] and stop[p[-1]] and all(follow[a, b] for a, b in zip(p, p[1:]))]
            best = max(sum(scores[t, k] for t, k in enumerate(p)) for p in valid)
            path = [labels.index(x) for x in sequence.bioes_viterbi(scores, labels)]
            assert tuple(path) in set(valid) and sum(scores[t, k] for t, k in enumerate(path)) == best


def longest(flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


def test_review_features_equal_plain_ones(spark):
    r = random.Random(11)
    names = ("front", "toc", "body", "back")
    pages = {}
    for d in range(6):
        for k in range(r.randint(1, 30)):
            w = [r.random() ** 3 for _ in names]
            pages.setdefault(d, []).append([x / sum(w) for x in w])
    frame = spark.createDataFrame([(d, k, *p) for d, ps in pages.items() for k, p in enumerate(ps)], "d long, k long, front double, toc double, body double, back double")
    for row in sequence.review_features(frame, "d", "k", {c: c for c in names}, "body", "back").collect():
        ps = pages[row.d]
        n = len(ps)
        labels = [names[max(range(4), key=lambda k: (p[k], names[k]))] for p in ps]
        top = [sorted(p, reverse=True) for p in ps]
        conf, margin = [t[0] for t in top], [t[0] - t[1] for t in top]
        late = [k + 1 > max(n // 2, n - 10) for k in range(n)]
        edge = [k > 0 and labels[k] != labels[k - 1] for k in range(n)]
        low, high = [c < sequence.LOW for c in conf], [1 - c * m > sequence.HIGH_RISK for c, m in zip(conf, margin)]
        rival = [abs(p[2] - p[3]) < sequence.LOW_MARGIN and max(p[2], p[3]) == c for p, c in zip(ps, conf)]
        wanted = {
            "pages": n, "toc_pages": labels.count("toc"), "boundaries": sum(edge), "body_to_back": sum(a == "body" and b == "back" for a, b in zip(labels, labels[1:])), "low_confidence_pages": sum(low), "late_low_confidence_pages": sum(a and b for a, b in zip(low, late)),
            "boundary_high_risk_pages": sum(a and b for a, b in zip(high, edge)), "low_confidence_longest_run": longest(low), "high_risk_longest_run": longest(high), "competition_pages": sum(rival), "competition_longest_run": longest(rival), "late_competition_pages": sum(a and b for a, b in zip(rival, late)),
            "worst3_confidence": sum(sorted(conf)[:3]) / min(3, n), "worst5_margin": sum(sorted(margin)[:5]) / min(5, n), "least_margin": min(margin), "mean_confidence": sum(conf) / n,
        }
        for name, value in wanted.items():
            assert abs(row[name] - value) < 1e-9, name
        assert 0 <= row.review_score <= 1


def test_repairs_stay_only_where_they_help():
    good = "\n".join(f"<article>ARTICLE {n} T</article>\n<section>Section {i}.1 A</section>\nbody\n<section>Section {i}.2 B</section>\nbody" for i, n in enumerate(["I", "II", "III", "IV", "V"], 1))
    assert repairs.repaired(good) == {"text": good, "applied": [], "before": 0, "after": 0}
    faults = {
        "split_missing_sections": good.replace("<section>Section 2.1 A</section>\nbody\n<section>Section 2.2 B</section>", "<section>Section 2.1 A Section 2.2 B</section>\nbody\n<section>Section 2.3 C</section>"),
        "split_embedded_sections": good.replace("<article>ARTICLE II T</article>\n<section>Section 2.1 A</section>", "<section>2. TERMS 2.1 A</section>"),
        "promote_whole_numbers": good.replace("<article>ARTICLE II T</article>", "<section>2. TERMS</section>"),
        "unwrap_bare_numbers": good.replace("<section>Section 3.2 B</section>", "<section>3.2</section> <section>Section 3.2 B</section>"),
        "unwrap_bare_labels": good.replace("<section>Section 3.2 B</section>", "<section>Section</section> <section>Section 3.2 B</section>"),
        "space_after_label": good.replace("<section>Section 3.2 B", "<section>Section3.2 B"),
        "page_number_before_tag": good.replace("<section>Section 3.2 B", "<section>14 Section 3.2 B"),
        "unwrap_inline_references": good.replace("body\n<section>Section 4.2", "see <section>Section 2.2</section> of this\n<section>Section 4.2"),
        "insert_missing_sections": good.replace("<section>Section 3.1 A</section>", "Section 3.1 A"),
        "wrap_untagged_articles": good.replace("<article>ARTICLE III T</article>", "ARTICLE III T"),
        "split_omitted_articles": good + "\n<article>ARTICLE VI [Reserved] ARTICLE VII [Reserved]</article>\n<section>Section 7.1 X</section> y",
    }
    for name, text in faults.items():
        out = repairs.repaired(text)
        assert out["applied"] == [name] and out["after"] == 0 < out["before"], name
    worse = good.replace("body", "see <section>Section 9.9</section> alone", 1)
    assert repairs.repaired(worse)["after"] <= repairs.repaired(worse)["before"]
    assert D.violation_codes(repairs.tagged_xml("<article>ARTICLE I T</article><section>x</section><section>y</section>")).count("section_title_invalid_numbering") == 2
    assert repairs.repaired(None)["before"] == 1


def test_likeness_of_concepts():
    assert concepts.likeness("", ["a"]) == (0.0, False) and concepts.likeness("no shop", ["no shop"]) == (1.0, True)
    score, matched = concepts.likeness("no shop", ["the no shop covenant"])
    assert matched and score == round(0.7 * 0.95 + 0.3, 4)
    assert concepts.likeness("zzz", ["steel"]) == (0.0, False)


def test_exhibit_classifier_learns(spark):
    r = random.Random(12)
    said = lambda good: ("AGREEMENT AND PLAN OF MERGER " if good else "CREDIT AGREEMENT ") + " ".join(r.choice(["merger", "closing", "target"] if good else ["loan", "lender", "interest"]) for _ in range(30))
    rows = [(i, said(i % 2), i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", None)], "doc_id long, text string, label int")
    out = {x.doc_id: x for x in exhibits.predict(exhibits.fit(docs.filter("doc_id < 60"), "doc_id"), docs, "doc_id", short=1).collect()}
    assert len(out) == 82 and all(out[i].positive == bool(i % 2) for i in range(60, 80)) and all(0 <= x.probability <= 1 for x in out.values())


def test_a_slot_loads_its_model_once_a_task(spark):
    import pandas as pd

    double = slots.register(spark, "double_it", lambda: lambda x: pd.Series(x * 2.0), "exhibit")
    rows = spark.range(5).select(F.col("id").cast("double").alias("x"))
    assert [r[0] for r in rows.select(double("x")).collect()] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_hidden_quotes_and_json_lists(spark):
    said = ['["a", "b"]', "[]", None, "", '["a"', '{"a": 1}', '["a", ]x', "[1]"]
    rows = spark.createDataFrame([(x,) for x in said], "s string").select(T.json_list(F.col("s")).alias("strict"), T.json_list(F.col("s"), False).alias("lenient")).collect()
    assert [r.strict for r in rows][:6] == [["a", "b"], [], None, None, None, None] and [r.lenient for r in rows][:6] == [["a", "b"], [], [], [], [], []]


def test_screens():
    assert D.screen_table("<p>TABLE</p><table><tr><td>1.1</td><td>The Merger</td><td>4</td></tr><tr><td>Exhibits</td></tr></table>", 40) == "TABLE\n1.1  The Merger ...................... 4\nExhibits"
    assert D.screen_signature("ACME  INC .\nBy:\n_____\nName:\nJohn ( Jack )\nTitle: CEO\nBETA LLC\nBy: ____") == "ACME INC.\nBy: ____\nName: John (Jack)\nTitle: CEO\n\nBETA LLC\nBy: ____"
    assert D.with_standard_ids("<a", {"x": "1"}) == "<a" and D.with_standard_ids(None, {}) is None


def test_a_download_goes_on_where_it_stopped(spark, tmp_path):
    calls = []

    def fetch(cursor):
        calls.append(cursor)
        if len(calls) == 2:
            raise OSError("cut off")
        at = int(cursor or 0)
        return [(at,), (at + 1,)], str(at + 2) if at < 4 else None

    with pytest.raises(OSError):
        readers.download_pages(spark, fetch, "id long", str(tmp_path / "x"))
    rows = readers.download_pages(spark, fetch, "id long", str(tmp_path / "x"))
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4, 5] and calls == [None, "2", "2", "4"]


def test_a_rebuild_holds_a_lock(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(RuntimeError):
        sinks.rebuild(spark, path, lambda: spark.range(1))
    (tmp_path / "t.lock").unlink()
    sinks.rebuild(spark, path, lambda: spark.range(3))
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.lock").exists()


def test_own_columns_clash_with_none_of_a_table(spark):
    rows = spark.createDataFrame([(k % 2, k, 10 - k, "x", "y", "z", "w", "v") for k in range(10)], "g long, k long, v long, _row string, _m string, _f string, _part string, _o string")
    first = sequence.first_n(rows, ["g"], ["k"], 2)
    assert first.columns == rows.columns and [(r.k, r._row) for r in first.orderBy("k").collect()] == [(0, "x"), (1, "x"), (2, "x"), (3, "x")]
    capped = search.capped_groups(rows, "g", [F.asc("k")], 1, F.col("v") > 3).collect()
    assert sorted((r.g, r.k, r._row, r._m, r.matched_count) for r in capped) == [(0, 0, "x", "y", 4), (1, 1, "x", "y", 3)]
    near = D.redacted(rows, "g", "k", F.col("k") == 4, 1, ["_o"]).collect()
    assert sorted(r.k for r in near if r._o == "v") == [2, 4, 6] and all(r._f == "z" for r in near)
    ran = {r.k: (r.s, r._part) for r in rollups.running(rows, "k", [F.asc("k")], {"s": F.col("v")}, parts=3).collect()}
    assert ran[3] == (34, "w") and ran[9] == (55, "w")
    since = sequence.since_last(rows, "g", "k", F.col("v") > 8).collect()
    assert all(r._o == "v" for r in since)


def test_clauses_have_their_places():
    text = "Intro:\n(a) one\n  (i) inner\n(b) two"
    out = D.clauses_of(text.split("\n"))
    assert [(c["anchor"], text[c["start"] : c["stop"]]) for c in out] == [("(a)", "Intro:\n(a) one\n  (i) inner"), ("(b)", "(b) two")]
    assert [c["method"] for c in D.clauses_of(["All of it."])] == ["whole_section"] and D.clauses_of(None) == []
    assert [c["method"] for c in D.clauses_of(["First.", "Second."])] == ["paragraph_split"] * 2
