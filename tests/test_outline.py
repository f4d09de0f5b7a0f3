"""Page attribution and the collapse of definitions, by hand."""

from folioforge.operators import documents as D
from folioforge.operators import outline as O
from folioforge.operators import tables


def test_pages_of_headings_and_pieces_within_lines(spark):
    text = """Leading <page>1</page> words
<pageUUID></pageUUID><article>ARTICLE I
 The  Merger</article> own text <pageUUID> a </pageUUID>
<section>Section 1.1 Closing</section>
“Term” or "Other" means all
goes on
<page>2</page>
and on <pageUUID>b</pageUUID>
<page>3</page>
"Next" has in this agreement the meaning
"Plain" is not one
<section>Section 1.2 End</section>
"""
    rows = spark.createDataFrame([(1, text), (2, "<section>no article</section>\nx"), (3, None), (4, "")], "id int, t string")
    got = O.elements(rows, "id", "t").orderBy("id", "k").collect()
    heads = [(r.id, r.kind, r.value, r.article_order, r.section_order, r.page) for r in got if r.kind in O.HEADINGS]
    assert heads == [(1, "article", "ARTICLE I The Merger", 1, 0, "a"), (1, "section", "Section 1.1 Closing", 1, 1, "b"), (1, "section", "Section 1.2 End", 1, 2, "b"), (2, "section", "no article", 0, 1, None)]
    assert [(r.kind, r.value, r.region) for r in got if r.id == 1][:4] == [("text", "Leading", "frontMatter"), ("page", "1", "frontMatter"), ("text", "words", "frontMatter"), ("pageUUID", "", "frontMatter")]
    assert {r.id for r in got} == {1, 2}
    found = O.collapsed_definitions(O.elements(rows, "id", "t"), "id").orderBy("k").collect()
    assert [(r.term, r.parts) for r in found] == [("term", ["text: goes on", "page: 2", "text: and on", "pageUUID: b", "page: 3", 'text: "Next" has in this agreement the meaning', 'text: "Plain" is not one'])]


def test_table_functions_in_sql_equal_their_functions(spark):
    tables.register(spark)
    xml = [
        '<document><body><article title="ARTICLE I A" pageUUID="p1"><section title="Section 1.1 X" pageUUID="p2"><text>a</text></section><section title="Section 2.4 Y" pageUUID="p3"/></article><article title="ARTICLE I B"><text>own</text></article></body></document>',
        "<broken", None, "<document/>", '<document><body><section title="Section 1.1"/></body></document>',
    ]
    rows = spark.createDataFrame(list(enumerate(xml)), "id int, x string").repartition(2)
    rows.createOrReplaceTempView("held")
    for name, (_, make) in tables.FUNCTIONS.items():
        got = sorted((tuple(r) for r in spark.sql(f"SELECT h.id, r.* FROM held h, LATERAL {name}(h.x) r").collect()), key=repr)
        assert got == sorted(((i, *r) for i, x in enumerate(xml) for r in make(x)), key=repr), name
    found = {(f["code"], f["detail"], *f["pages"]) for f in D.violations_of(xml[0])}
    assert {("section_article_mismatch", "Section 2.4 Y: in article 1", "p3"), ("section_non_sequential", "Section 2.4 Y: expected 2.2", "p3"), ("articles_out_of_order", "ARTICLE I B: after 1"), ("too_few_articles", "2 of 5", "p1")} == found
