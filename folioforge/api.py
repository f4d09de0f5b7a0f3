"""The search surface: what a reader of the corpus asks, each as a DataFrame over tables it is given.

Filters that are None or empty ask nothing. Pages have `has_next`; sizes are clamped to the reader's limit. Tables have the columns
of the reference's data model: agreements by agreement_uuid, sections by section_uuid, clauses by clause_uuid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import predicates as P
from folioforge.functions import text as T
from folioforge.operators import concepts, rollups, search
from folioforge.operators.joins import expand_taxonomy, label_of, parent_chain

MOST = {"reader": 100, "guest": 10}


def _page(rows: DataFrame, order: Sequence[Column], number: int, size: int | None, tier: str) -> DataFrame:
    return search.page(rows, list(order), max(1, number), P.clamp_page_size(size, MOST[tier]))


def _years(rows: DataFrame, years: Sequence[int] | None, date: str = "filing_date") -> DataFrame:
    return rows.filter(P.in_years(F.col(date), years)) if years else rows


def search_agreements(agreements: DataFrame, facets: dict[str, Sequence] | None = None, years: Sequence[int] | None = None, prices: Sequence[str] | None = None, counsel: str | None = None, page: int = 1, size: int | None = None, tier: str = "guest") -> DataFrame:
    """Agreements that pass all filters, the latest first."""
    rows = _years(agreements.filter(P.facets(facets or {})), years)
    if prices:
        rows = rows.filter(P.in_buckets(F.col("transaction_price_total"), prices))
    if counsel:
        named = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(counsel.lower())) for c in ("target_counsel", "acquirer_counsel")]
        rows = rows.filter(P.any_of(named))
    return _page(rows, [F.desc_nulls_last("filing_date"), F.asc("agreement_uuid")], page, size, tier)


def search_sections(sections: DataFrame, agreements: DataFrame, standard_ids: DataFrame | None = None, nodes: DataFrame | None = None, asked: DataFrame | None = None, facets: dict[str, Sequence] | None = None, years: Sequence[int] | None = None, page: int = 1, size: int | None = None, tier: str = "guest") -> DataFrame:
    """Sections of agreements that pass the filters; with asked (id), those that have one of these ids or one below it in nodes (id, parent)."""
    kept = _years(agreements.filter(P.facets(facets or {})), years).select("agreement_uuid", "filing_date")
    rows = sections.join(kept, "agreement_uuid")
    if asked is not None:
        wanted = expand_taxonomy(nodes, asked, 3).select(F.col("id").alias("standard_id"))
        rows = rows.join(standard_ids.join(wanted, "standard_id", "left_semi").select("section_uuid").distinct(), "section_uuid", "left_semi")
    return _page(rows, [F.desc_nulls_last("filing_date"), F.asc("agreement_uuid"), F.asc("section_uuid")], page, size, tier)


def search_tax_clauses(clauses: DataFrame, assigned: DataFrame, asked: DataFrame, with_warranties: bool = False, page: int = 1, size: int | None = None, tier: str = "guest") -> DataFrame:
    """Clauses with one of the asked standard ids (id); representations and warranties only if they are asked for."""
    rows = clauses if with_warranties else clauses.filter("context_type <> 'rep_warranty'")
    hits = assigned.join(asked.select(F.col("id").alias("standard_id")), "standard_id", "left_semi").select("clause_uuid").distinct()
    return _page(rows.join(hits, "clause_uuid", "left_semi"), [F.asc("agreement_uuid"), F.asc("clause_order"), F.asc("clause_uuid")], page, size, tier)


def get_agreement(agreements: DataFrame, agreement_uuid: str) -> DataFrame:
    return agreements.filter(F.col("agreement_uuid") == agreement_uuid)


def list_agreement_sections(sections: DataFrame, agreement_uuid: str) -> DataFrame:
    return sections.filter(F.col("agreement_uuid") == agreement_uuid).orderBy("article_order", "section_order", "section_uuid")


def list_agreement_tax_clauses(clauses: DataFrame, agreement_uuid: str) -> DataFrame:
    return clauses.filter(F.col("agreement_uuid") == agreement_uuid).orderBy("clause_order", "clause_uuid")


def list_section_tax_clauses(clauses: DataFrame, section_uuid: str) -> DataFrame:
    return clauses.filter(F.col("section_uuid") == section_uuid).orderBy("clause_order", "clause_uuid")


def get_section_snippet(sections: DataFrame, section_uuid: str, term: str, size: int = 220) -> DataFrame:
    rows = sections.filter(F.col("section_uuid") == section_uuid)
    return rows.select("section_uuid", T.focused_snippet(T.stripped_tags(F.col("xml_content")), [term], size)[0].alias("snippet"))


def list_filter_options(agreements: DataFrame, facets: Sequence[str]) -> DataFrame:
    """facet, value, n."""
    return rollups.facet_counts(agreements, facets)


def list_taxonomy(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """The leaves with their ancestors. Tables: id, label, parent_id."""
    return parent_chain(l3, l2, l1)


def list_naics(codes: DataFrame, sectors: DataFrame, sub_sectors: DataFrame) -> DataFrame:
    """codes (code) with their labels; a sub-sector's name goes before its sector's."""
    return label_of(codes, "code", sectors, sub_sectors)


def list_counsel(names: DataFrame) -> DataFrame:
    """key, name, n of counsel (raw_name): the name most often used of each firm."""
    counted = names.select(T.counsel_key(T.firm_display(F.col("raw_name"))).alias("key"), F.col("raw_name").alias("name")).filter("key <> ''").groupBy("key", "name").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.sum("n").alias("n"))


def suggest_clause_families(wanted: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The k labels most like each concept, with fit and confidence."""
    return concepts.matched_concepts(wanted, labels, k)


def get_agreement_trends(agreements: DataFrame, by: str) -> DataFrame:
    """year, `by`, n, total and price quartiles."""
    rows = agreements.withColumns({"year": F.year("filing_date"), by: F.coalesce(by, F.lit("unknown"))})
    sums = rows.groupBy("year", by).agg(F.count("*").alias("n"), F.sum(F.col("transaction_price_total").cast("decimal(18,2)")).alias("total"))
    return sums.join(rollups.quantiles(rows, ["year", by], "transaction_price_total", {"p25": 0.25, "median": 0.5, "p75": 0.75}), ["year", by])


def get_agreements_summary(agreements: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: how many of each there are."""
    parts = {"agreements": agreements, "sections": sections, "pages": pages}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
