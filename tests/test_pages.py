"""Page layout against plain code, corrections of labels, and the chain model against brute force."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import crf
from folioforge.operators import pages as P

ANY = re.IGNORECASE


def plain_page(text, number, total):
    """The features of one page, worked out again from their definitions."""
    lines = [x.strip() for x in (text.splitlines() or [text])]
    filled = [x for x in lines if x]
    tokens = re.findall(r"[A-Za-z][A-Za-z&'.-]*", text)
    top, place = filled[:5], number / total
    head = lambda pattern, k=5: any(re.match(pattern, x, ANY) for x in top[:k])
    has = lambda pattern, flags=0: bool(re.search(pattern, text, ANY | flags))
    article = lambda x: bool(re.match(r"\s*article\s+[0-9ivxlcdm]+\b", x, ANY))
    section = lambda x: bool(re.match(r"\s*(?:section|clause)?\s*\d+(?:\.\d+)*(?:\([a-z0-9]+\))*[\.\)]?\s+[A-Z]", x, ANY))
    anchor = lambda words: any(re.match(rf"\s*(?:{words})\b(?:\s+[A-Z0-9][A-Z0-9 .()/_-]*)?\s*$", x.upper()) for x in top)
    quoted = len(re.findall('["“][A-Z][^"”]{1,80}["”]', text))
    fragments = 0
    for m in re.finditer(r"[A-Z][A-Za-z&'/-]*(?:\s+[A-Z][A-Za-z&'/-]*){0,5}", text[:220].replace("\n", " ")):
        x = m.group().strip()
        fragments += len(x.split()) <= 6 and len(x) >= 4 and len(re.findall(r"[A-Za-z][A-Za-z&'/-]*", x)) >= 2
    deed, signature = has(r"\bexecuted\s+\(?.{0,30}as a deed\b"), has(r"\bsignature of witness\b")
    address, occupation = has(r"\bwitness name\s*:|\baddress\s*:"), has(r"\boccupation\s*:")
    contents = head("table of contents\\b", 2)
    fifth, tenth = math.ceil(total * 0.2), math.ceil(total * 0.1)
    upper = [x for x in filled[:8] if any(c.isalpha() for c in x) and x == x.upper()]
    return {
        "page_index": number - 1, "pages_remaining": total - number, "relative_page": place, "in_first_quintile": number <= fifth, "in_first_decile": number <= tenth, "in_last_quintile": number > total - fifth, "in_last_decile": number > total - tenth,
        "whitespace_ratio": sum(c.isspace() for c in text) / max(len(text), 1), "avg_line_length": sum(map(len, lines)) / len(lines), "short_line_ratio": sum(len(x) <= 40 for x in lines) / len(lines), "heading_line_ratio": len(upper) / max(len(filled[:8]), 1),
        "is_all_caps_heavy": sum(len(x) > 1 and x == x.upper() for x in tokens) / max(len(tokens), 1) >= 0.35, "has_article_heading": any(map(article, top)), "has_section_heading": any(map(section, top)),
        "article_heading_count": sum(map(article, filled[:12])), "section_heading_count": sum(map(section, filled[:12])), "section_mentions": len(re.findall(r"\bsection\b", text, ANY)), "article_mentions": len(re.findall(r"\barticle\b", text, ANY)),
        "has_toc_dots": "......" in text, "has_sig_block": has(r"\bIN WITNESS WHEREOF\b|^\s*(?:By|Title)\s*:", re.MULTILINE), "has_annex_anchor": anchor("EXHIBIT|SCHEDULE|ANNEX|APPENDIX|ATTACHMENT"), "has_appendix_anchor": anchor("APPENDIX|ATTACHMENT"),
        "has_definitions_heading": head(r"definitions?\s*$"), "starts_with_table_of_contents": contents, "has_standalone_agreement_title": head(r"(?:form of\s+)?[A-Z][A-Z0-9 ,.'&()/:-]{0,120}\bagreement\b", 3), "has_intentionally_omitted": bool(re.search(r"\bintentionally omitted\b", " ".join(top[:3]), ANY)),
        "has_list_of_exhibits": has(r"\blist of exhibits\b"), "has_list_of_schedules": has(r"\blist of schedules\b"), "has_particulars_heading": has(r"\bparticulars of\b"), "has_form_of": has(r"\bform of\b"), "has_counterparts": has(r"\bcounterparts?\b"),
        "has_executed_as_deed": deed, "has_witness_signature": signature, "has_witness_address": address, "has_witness_occupation": occupation, "witness_block_combo": deed and (signature or address or occupation),
        "annex_keyword_count": len(re.findall(r"\b(?:schedules?|exhibits?|annex|annexes|appendix|appendices|attachments?)\b", text, ANY)), "leading_heading_fragment_count": fragments,
        "late_disclosure_heading_cluster": fragments >= 3 and place >= 0.55 and not any(map(section, top)) and not any(map(article, top)) and not contents, "quoted_term_count": quoted, "quoted_term_ratio": quoted / max(len(tokens), 1),
    }


def plain_document(texts):
    pages = [plain_page(x, k + 1, len(texts)) for k, x in enumerate(texts)]
    annex = [p["has_annex_anchor"] or p["has_appendix_anchor"] or p["has_list_of_exhibits"] or p["has_list_of_schedules"] or p["has_definitions_heading"] or p["has_particulars_heading"] or p["annex_keyword_count"] >= 3 for p in pages]
    entry = [p["relative_page"] >= 0.45 and (p["has_annex_anchor"] or p["has_appendix_anchor"] or p["has_standalone_agreement_title"] or p["starts_with_table_of_contents"]) for p in pages]
    out = []
    for k, p in enumerate(pages):
        q = dict(p)
        for side, j in (("prev", k - 1), ("next", k + 1)):
            inside = 0 <= j < len(pages)
            for name in P.AROUND:
                q[f"{side}_page_{name}"] = inside and bool(entry[j] if name == "has_attached_subdocument_entry" else pages[j][name])
            q[f"{side}_page_relative_page"] = pages[j]["relative_page"] if inside else float(side == "next")
        for flags, what, back, reaches in ((annex, "annex_context", 5, (3, 10)), (entry, "attached_subdocument", 8, (40,))):
            prior = [] if flags[k] else [j for j in range(k) if flags[j]]
            since, recent = k - prior[-1] if prior else len(pages), sum(flags[max(0, k - back + 1) : k + 1])
            q |= {f"has_prior_{what}": bool(prior), f"pages_since_last_{what}": since, f"recent_{what}_count_{back}": recent} | {f"recent_{what}_window_{r}": recent >= 1 and since <= r for r in reaches}
        out.append(q)
    return out


DOCUMENTS = [
    ["TABLE OF CONTENTS\nArticle I ......... 3\n", "AGREEMENT\n\nThis Merger Agreement is made", "ARTICLE IV\nSection 4.1 The Company  \"Material Adverse Effect\" means", "in witness whereof\n\n By: ____\nTitle: X", "EXHIBIT A\nForm of Note", "", "  \n\t", "Appendix\nlist of exhibits"],
    ["\r\nDefinitions\r\r\nx", "4.2(a) Hello\x0bWorld\u0085NEXT LINE", "Executed (by the Company) as a deed\nSignature of Witness\nAddress : x\noccupation:", "John Smith Mary Jones\nBig Red Dog. Other Firm Name, Further Name & Co", "SCHEDULE 1 (PART A)\nschedule exhibits ANNEXES", "Form of Escrow Agreement", "section section Sections", "ÉTÉ ANNEX B", "Annex B", "a" * 500, "Intentionally\nOmitted", "intentionally omitted"],
    [""],
]


def test_layout_equals_plain_code(spark):
    rows = [(d, k, text) for d, texts in enumerate(DOCUMENTS) for k, text in enumerate(texts)]
    got = P.with_surroundings(P.with_layout(spark.createDataFrame(rows, "doc int, page int, text string"), "doc", "page", "text"), "doc", "page")
    found = {(r.doc, r.page): r.asDict() for r in got.collect()}
    for d, texts in enumerate(DOCUMENTS):
        for k, want in enumerate(plain_document(texts)):
            have = {c: found[d, k][c] for c in want}
            assert have == pytest.approx(want), (d, k, {c: (have[c], want[c]) for c in want if have[c] != pytest.approx(want[c])})
    assert len(want) == 64 and set(got.columns) == {"doc", "page", "text", *want}
    null = P.with_layout(spark.createDataFrame([(1, 1, None)], "doc int, page int, text string"), "doc", "page", "text").first()
    assert null.relative_page == 1.0 and null.whitespace_ratio == 0.0


def brute_sum(scores, w):
    n, k = scores.shape
    worth = {}
    for path in itertools.product(range(k), repeat=n):
        worth[path] = w.start[path[0]] + w.stop[path[-1]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(w.steps[a, b] for a, b in zip(path, path[1:]))
    return worth


@pytest.fixture
def short():
    r = np.random.default_rng(3)
    lengths = np.array([3, 1, 4, 2, 3])
    return r.normal(size=(13, 2)), r.integers(0, 3, 13), lengths, crf.Weights.of(r.normal(size=3 * 2 + 9 + 9), 3, 2)


def test_sums_and_labels_equal_all_paths(short):
    features, labels, lengths, w = short
    scores = features @ w.rows.T + w.bias
    at, total, best = 0, 0.0, []
    for n in lengths:
        worth = brute_sum(scores[at : at + n], w)
        top = max(worth.values())
        total += top + math.log(sum(math.exp(v - top) for v in worth.values())) - worth[tuple(labels[at : at + n])]
        best += max(worth, key=worth.get)
        at += n
    assert crf.loss(features, labels, lengths, w)[0] == pytest.approx(total)
    assert crf.best_labels(features, lengths, w).tolist() == best


def test_gradient_equals_differences(short):
    features, labels, lengths, w = short
    flat, slope = w.flat(), crf.loss(features, labels, lengths, w)[1]
    for i in range(len(flat)):
        step = np.eye(len(flat))[i] * 1e-6
        value = lambda x: crf.loss(features, labels, lengths, crf.Weights.of(x, 3, 2))[0]
        assert slope[i] == pytest.approx((value(flat + step) - value(flat - step)) / 2e-6, abs=1e-5)


def test_chain_model_beats_rows_alone_on_held_out_documents(spark):
    r = np.random.default_rng(7)
    rows = []
    for d in range(200):
        label = 0
        for k in range(int(r.integers(4, 12))):
            label = min(2, label + int(r.random() < 0.35))
            rows.append((d, k, "abc"[label], [float(label + r.normal() * 1.2), float(r.normal())]))
    table = spark.createDataFrame(rows, "doc int, page int, label string, f array<double>").repartition(3)
    model = crf.fit(table.filter("doc < 150"), "doc", "page", F.col("f"), F.col("label"), "abc", strength=0.1)
    share = lambda found: found.join(table, ["doc", "page"]).filter("doc >= 150").agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    chain, rising = crf.predict(model, table, "doc", "page", F.col("f")), crf.predict(model, table, "doc", "page", F.col("f"), rising=True)
    alone = crf.fit(table.filter("doc < 150").withColumn("one", F.struct("doc", "page")), "one", "page", F.col("f"), F.col("label"), "abc", strength=0.1)
    single = crf.predict(alone, table.withColumn("one", F.struct("doc", "page")), "one", "page", F.col("f")).select("one.doc", "page", "predicted")
    assert share(chain) > share(single) + 0.1 and share(rising) >= share(chain) - 0.02
    order = {(x.doc, x.page): x.predicted for x in rising.collect()}
    assert len(order) == len(rows) and all(order[d, k] <= order[d, k + 1] for d, k in order if (d, k + 1) in order)


def test_documents_with_rows_that_have_no_label_are_not_used(spark):
    rows = [(1, 0, "a", [1.0]), (1, 1, None, [2.0]), (2, 0, "a", [1.0]), (2, 1, "b", [3.0])]
    table = spark.createDataFrame(rows, "doc int, page int, label string, f array<double>")
    model = crf.fit(table, "doc", "page", F.col("f"), F.col("label"), "ab")
    assert model.means.tolist() == [2.0] and crf.predict(model, table.limit(0), "doc", "page", F.col("f")).count() == 0
    with pytest.raises(ValueError, match="labelled"):
        crf.fit(table.filter("doc = 1"), "doc", "page", F.col("f"), F.col("label"), "ab")


def test_early_back_matter(spark):
    """By hand: pages look like a body, so back matter up to the page that signs is body; a document without back matter is left alone."""
    labels = ["toc", "back_matter", "back_matter", "body", "back_matter", "sig", "toc", "back_matter"]
    rows = [(1, k, x, k / 20, k < 6, k == 5) for k, x in enumerate(labels)] + [(2, k, x, k / 20, True, False) for k, x in enumerate(["body", "toc"])] + [(3, k, x, k / 20, False, False) for k, x in enumerate(["body", "back_matter", "body"])]
    table = spark.createDataFrame(rows, "doc int, page int, label string, relative_page double, has_section_heading boolean, sig_context boolean")
    table = table.withColumns({c: F.lit(False) for c in ("has_article_heading", "has_annex_anchor", "has_appendix_anchor", "has_list_of_exhibits", "has_list_of_schedules")})
    got = {(r.doc, r.page): (r.settled, r.modified) for r in P.settled_labels(table, "doc", "page", "label").collect()}
    assert [got[1, k] for k in range(8)] == [("toc", False), ("body", True), ("body", True), ("body", False), ("body", True), ("sig", False), ("sig", True), ("back_matter", False)]
    assert [got[2, k] for k in range(2)] == [("body", False), ("toc", False)]
    assert [got[3, k] for k in range(3)] == [("body", False), ("back_matter", False), ("back_matter", True)]
