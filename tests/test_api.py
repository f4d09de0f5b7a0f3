"""The search surface over small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioforge import api


@pytest.fixture(scope="module")
def tables(spark):
    day = datetime.date
    agreements = [(f"a{i:02d}", day(2000 + i % 5, 1, 1 + i), float(i * 40_000_000), "Smith LLP" if i % 2 else "Jones & Co", None, "stock" if i % 3 else None) for i in range(20)]
    sections = [(f"a{i:02d}", f"s{i:02d}{k}", k // 2, k, f"<p>Text {i} the closing {k}</p>") for i in range(20) for k in range(3)]
    return {
        "agreements": spark.createDataFrame(agreements, "agreement_uuid string, filing_date date, transaction_price_total double, target_counsel string, acquirer_counsel string, deal_type string"),
        "sections": spark.createDataFrame(sections, "agreement_uuid string, section_uuid string, article_order int, section_order int, xml_content string"),
        "ids": spark.createDataFrame([(f"s{i:02d}0", "n3") for i in range(5)] + [("s070", "n2"), ("s071", "other")], "section_uuid string, standard_id string"),
        "nodes": spark.createDataFrame([("n1", None), ("n2", "n1"), ("n3", "n2"), ("other", None)], "id string, parent string"),
    }


def test_agreements(tables):
    found = api.search_agreements(tables["agreements"], {"deal_type": ["stock"]}, years=[2001, 2002], size=3).collect()
    assert [r.agreement_uuid for r in found] == ["a17", "a07", "a02"] and all(r.has_next for r in found)
    assert api.search_agreements(tables["agreements"], prices=["0 - 100M"], counsel="smith").count() == 1
    assert api.search_agreements(tables["agreements"], size=500).count() == 10 and api.search_agreements(tables["agreements"], size=500, tier="reader").count() == 20
    assert api.get_agreement(tables["agreements"], "a03").count() == 1


def test_sections(tables, spark):
    asked = spark.createDataFrame([("n1",)], "id string")
    found = api.search_sections(tables["sections"], tables["agreements"], tables["ids"], tables["nodes"], asked)
    assert sorted(r.section_uuid for r in found.collect()) == ["s000", "s010", "s020", "s030", "s040", "s070"]
    assert [r.section_uuid for r in api.list_agreement_sections(tables["sections"], "a01").collect()] == ["s010", "s011", "s012"]
    assert api.get_section_snippet(tables["sections"], "s010", "closing", 12).first().snippet == "...the closing..."


def test_clauses(spark):
    clauses = spark.createDataFrame([("c1", "a", "s", 1, "operative"), ("c2", "a", "s", 2, "rep_warranty"), ("c3", "b", "t", 1, "operative")], "clause_uuid string, agreement_uuid string, section_uuid string, clause_order int, context_type string")
    assigned = spark.createDataFrame([("c1", "x"), ("c2", "x"), ("c3", "y")], "clause_uuid string, standard_id string")
    asked = spark.createDataFrame([("x",)], "id string")
    assert [r.clause_uuid for r in api.search_tax_clauses(clauses, assigned, asked).collect()] == ["c1"]
    assert [r.clause_uuid for r in api.search_tax_clauses(clauses, assigned, asked, True).collect()] == ["c1", "c2"]
    assert api.list_agreement_tax_clauses(clauses, "a").count() == 2 and api.list_section_tax_clauses(clauses, "t").count() == 1


def test_lists_and_summaries(tables, spark):
    trend = {(r.year, r.deal_type): r for r in api.get_agreement_trends(tables["agreements"], "deal_type").collect()}
    assert sum(r.n for r in trend.values()) == 20 and (2000, "unknown") in trend
    assert tuple(api.get_agreements_summary(tables["agreements"], tables["sections"], tables["nodes"]).first()) == (20, 60, 4)
    assert {(r.facet, r.value): r.n for r in api.list_filter_options(tables["agreements"], ["deal_type"]).collect()} == {("deal_type", "stock"): 13}
    names = spark.createDataFrame([("Smith LLP",), ("SMITH, L.L.P.",), ("Smith LLP",), ("Jones P.C.",)], "raw_name string")
    assert {r.key: (r.name, r.n) for r in api.list_counsel(names).collect()} == {"smith": ("Smith LLP", 3), "jones": ("Jones P.C.", 1)}
    labels = spark.createDataFrame([("1", "No Shop", ["No Shop"])], "id string, label string, terms array<string>")
    asked = spark.createDataFrame([(7, "no-shop")], "concept_id int, concept string")
    assert api.suggest_clause_families(asked, labels).first().fit == "canonical"
    l1, l2, l3 = (spark.createDataFrame(x, "id string, label string, parent_id string") for x in ([("a", "A", None)], [("b", "B", "a")], [("c", "C", "b"), ("d", "D", "none")]))
    assert [tuple(r) for r in api.list_taxonomy(l1, l2, l3).collect()] == [("c", "C", "B", "A")]
    codes, sector = spark.createDataFrame([("31",)], "code string"), spark.createDataFrame([("31", "Making")], "code string, label string")
    assert api.list_naics(codes, sector, sector.filter(F.lit(False))).first().label == "Making"
