"""Features of a document's pages: of a page's own lines and words, and of the pages around it; and what they say of early back matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let

#: Patterns looked for in a whole page, in any case.
SAID = {
    "has_toc_dots": r"\.{6,}",
    "has_sig_block": r"(?m)\bIN WITNESS WHEREOF\b|^\s*(?:By|Title)\s*:",
    "has_list_of_exhibits": r"\blist of exhibits\b",
    "has_list_of_schedules": r"\blist of schedules\b",
    "has_particulars_heading": r"\bparticulars of\b",
    "has_form_of": r"\bform of\b",
    "has_counterparts": r"\bcounterparts?\b",
    "has_executed_as_deed": r"\bexecuted\s+\(?.{0,30}as a deed\b",
    "has_witness_signature": r"\bsignature of witness\b",
    "has_witness_address": r"\bwitness name\s*:|\baddress\s*:",
    "has_witness_occupation": r"\boccupation\s*:",
}
#: Patterns that are counted in a whole page, in any case but for a defined term's first letter.
COUNTED = {
    "section_mentions": r"(?iU)\bsection\b",
    "article_mentions": r"(?iU)\barticle\b",
    "annex_keyword_count": r"(?iU)\b(?:schedule|schedules|exhibit|exhibits|annex|annexes|appendix|appendices|attachment|attachments)\b",
    "quoted_term_count": "[\"“][A-Z][^\"”]{1,80}[\"”]",
}
#: Patterns at the start of a line, and in how many of a page's first lines they are looked for.
ARTICLE_LINE = r"(?iU)^\s*article\s+[0-9ivxlcdm]+\b"
SECTION_LINE = r"(?iU)^\s*(?:section|clause)?\s*\d+(?:\.\d+)*(?:\([a-z0-9]+\))*[\.\)]?\s+[A-Z]"
ANNEX_TAIL = r"\b(?:\s+[A-Z0-9][A-Z0-9 .()/_-]*)?\s*$"
HEADED = {
    "has_annex_anchor": (rf"(?iU)^\s*(?:EXHIBIT|SCHEDULE|ANNEX|APPENDIX|ATTACHMENT){ANNEX_TAIL}", 5),
    "has_appendix_anchor": (rf"(?iU)^\s*(?:APPENDIX|ATTACHMENT){ANNEX_TAIL}", 5),
    "has_definitions_heading": (r"(?iU)^\s*definitions?\s*$", 5),
    "has_article_heading": (ARTICLE_LINE, 5),
    "has_section_heading": (SECTION_LINE, 5),
    "starts_with_table_of_contents": (r"(?iU)^\s*table of contents\b", 2),
    "has_standalone_agreement_title": (r"(?iU)^\s*(?:form of\s+)?[A-Z][A-Z0-9 ,.'&()/:-]{0,120}\bagreement\b", 3),
}
OMITTED = r"(?iU)\bintentionally omitted\b"
FRAGMENT = r"(?U)[A-Z][A-Za-z&'/-]*(?:\s+[A-Z][A-Za-z&'/-]*){0,5}"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines_of(text: Column) -> Column:
    """The lines of a text, each without blanks at its ends; a last line end begins no line."""
    split = F.split(text, LINE_ENDS, -1)
    ended = (F.size(split) > 1) & (F.element_at(split, -1) == "")
    return F.transform(F.when(ended, F.slice(split, 1, F.size(split) - 1)).otherwise(split), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def share_of(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def page_layout(text: Column, number: Column, pages: Column) -> dict[str, Column]:
    """41 features of a page, from its text, its number from 1 on and its document's number of pages; `lines`, `filled` and `tokens`
    have to be columns already (see with_layout)."""
    n = F.greatest(pages, F.lit(1))
    lines, filled, tokens = F.col("_lines"), F.col("_filled"), F.col("_tokens")
    count = lambda xs, keep: F.size(F.filter(xs, keep))
    headed = lambda pattern, k: F.exists(F.slice(filled, 1, k), lambda x: x.rlike(pattern))
    found = {name: headed(*where) for name, where in HEADED.items()}
    said = {name: text.rlike(f"(?iU){pattern}") for name, pattern in SAID.items()}
    counts = {name: F.regexp_count(text, F.lit(pattern)).cast("double") for name, pattern in COUNTED.items()}
    caps = count(tokens, lambda x: (F.length(x) > 1) & (F.upper(x) == x))
    heads = F.slice(filled, 1, 8)
    fifth, tenth = F.ceil(n * F.lit(0.2)), F.ceil(n * F.lit(0.1))
    place = number.cast("double") / n
    start = F.regexp_extract_all(F.replace(F.substring(text, 1, 220), F.lit("\n"), F.lit(" ")), F.lit(FRAGMENT), F.lit(0))
    words = lambda x: F.regexp_count(x, F.lit(r"[A-Za-z][A-Za-z&'/-]*"))
    fragments = count(start, lambda x: (F.size(F.split(F.trim(x), r"\s+")) <= 6) & (F.length(F.trim(x)) >= 4) & (words(x) >= 2)).cast("double")
    deed = said["has_executed_as_deed"] & (said["has_witness_signature"] | said["has_witness_address"] | said["has_witness_occupation"])
    return {
        "page_index": (number - 1).cast("double"), "pages_remaining": F.greatest(pages - number, F.lit(0)).cast("double"), "relative_page": place,
        "in_first_quintile": number <= fifth, "in_first_decile": number <= tenth, "in_last_quintile": number > n - fifth, "in_last_decile": number > n - tenth,
        "whitespace_ratio": share_of(F.regexp_count(text, F.lit(r"(?U)\s")), F.length(text)),
        "avg_line_length": share_of(F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)), F.size(lines)), "short_line_ratio": share_of(count(lines, lambda x: F.length(x) <= 40), F.size(lines)),
        "heading_line_ratio": share_of(count(heads, lambda x: x.rlike(r"\p{L}") & (x == F.upper(x))), F.size(heads)), "is_all_caps_heavy": share_of(caps, F.size(tokens)) >= 0.35,
        **found, **said, **counts,
        "article_heading_count": count(F.slice(filled, 1, 12), lambda x: x.rlike(ARTICLE_LINE)).cast("double"), "section_heading_count": count(F.slice(filled, 1, 12), lambda x: x.rlike(SECTION_LINE)).cast("double"),
        "has_intentionally_omitted": F.array_join(F.slice(filled, 1, 3), " ").rlike(OMITTED), "witness_block_combo": deed, "leading_heading_fragment_count": fragments,
        "late_disclosure_heading_cluster": (fragments >= 3) & (place >= 0.55) & ~found["has_section_heading"] & ~found["has_article_heading"] & ~found["starts_with_table_of_contents"],
        "quoted_term_ratio": share_of(counts["quoted_term_count"], F.size(tokens)),
    }


#: What is told of the page before and of the page after.
AROUND = ("has_annex_anchor", "has_appendix_anchor", "has_definitions_heading", "has_section_heading", "has_sig_block", "has_attached_subdocument_entry")


def with_layout(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """pages with the features of each page by itself (page_layout). A null text counts as empty."""
    w = Window.partitionBy(key)
    said = pages.withColumns({"_text": F.coalesce(text, F.lit("")), "_k": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    lines = let(lines_of(F.col("_text")), lambda x: F.struct(x.alias("all"), F.filter(x, lambda s: s != "").alias("filled")))
    said = said.withColumns({"_both": lines, "_tokens": F.regexp_extract_all("_text", F.lit(r"[A-Za-z][A-Za-z&'.-]*"), F.lit(0))})
    said = said.withColumns({"_lines": F.col("_both.all"), "_filled": F.col("_both.filled")})
    return said.withColumns(page_layout(F.col("_text"), F.col("_k"), F.col("_n"))).drop("_text", "_n", "_both", "_lines", "_filled", "_tokens")


def with_surroundings(pages: DataFrame, key: str, order: str) -> DataFrame:
    """pages with layout, and what the pages before and after say: their anchors, and how far back an annex, or an attached document, began."""
    w = Window.partitionBy(key).orderBy(order)
    c = F.col
    annex = c("has_annex_anchor") | c("has_appendix_anchor") | c("has_list_of_exhibits") | c("has_list_of_schedules") | c("has_definitions_heading") | c("has_particulars_heading") | (c("annex_keyword_count") >= 3)
    entry = (c("relative_page") >= 0.45) & (c("has_annex_anchor") | c("has_appendix_anchor") | c("has_standalone_agreement_title") | c("starts_with_table_of_contents"))
    made = pages.withColumns({"_annex": annex, "has_attached_subdocument_entry": entry, "_all": F.count("*").over(Window.partitionBy(key)).cast("double")})
    added: dict[str, Column] = {}
    for name in AROUND:
        added |= {f"prev_page_{name}": F.coalesce(F.lag(name).over(w), F.lit(False)), f"next_page_{name}": F.coalesce(F.lead(name).over(w), F.lit(False))}
    added |= {"prev_page_relative_page": F.coalesce(F.lag("relative_page").over(w), F.lit(0.0)), "next_page_relative_page": F.coalesce(F.lead("relative_page").over(w), F.lit(1.0))}
    for flag, what, back, reaches in (("_annex", "annex_context", 5, (3, 10)), ("has_attached_subdocument_entry", "attached_subdocument", 8, (40,))):
        last = F.last(F.when(c(flag), c("_k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        prior = last.isNotNull() & (last < c("_k"))  # a page that is one itself has none behind it
        since = F.when(prior, (c("_k") - last).cast("double")).otherwise(c("_all"))
        recent = F.sum(c(flag).cast("int")).over(w.rowsBetween(1 - back, 0)).cast("double")
        added |= {f"has_prior_{what}": prior, f"pages_since_last_{what}": since, f"recent_{what}_count_{back}": recent}
        added |= {f"recent_{what}_window_{reach}": (recent >= 1) & (since <= reach) for reach in reaches}
    return made.withColumns(added).drop("_annex", "_all", "_k", "has_attached_subdocument_entry")


#: Limits of early back matter.
EARLY, WINDOW, BODY_SHARE, ANNEX_SHARE, LATE = 0.45, 16, 0.40, 0.20, 0.75
LABELS = ("front_matter", "toc", "body", "sig", "back_matter")


def sig_context() -> Column:
    """A page that signs, or says how it is signed, by its layout."""
    names = ("has_sig_block", "has_counterparts", "has_executed_as_deed", "witness_block_combo", "has_witness_signature", "has_witness_address", "has_witness_occupation")
    return F.greatest(*[F.col(c) for c in names])


def settled_labels(pages: DataFrame, key: str, order: str, label: str, signs: str = "sig_context") -> DataFrame:
    """settled and modified: predicted labels after two corrections, in documents with back matter; the others stay as they are.

    Back matter that begins before EARLY, with no signature page before it, in pages that look like a body (a section or article
    heading in at least BODY_SHARE of the WINDOW pages from there on, an annex or list of them in at most ANNEX_SHARE), is body, up
    to the next page that signs, or past LATE an appendix or list. Then labels that fall behind an earlier one become that one.
    pages: relative_page, has_section_heading, has_article_heading, has_annex_anchor, has_appendix_anchor, has_list_of_exhibits,
    has_list_of_schedules and signs; labels: LABELS.
    """
    c, whole = F.col, Window.partitionBy(key)
    w = whole.orderBy(order)
    back, sig = LABELS[4], LABELS[3]
    rows = pages.withColumn("_k", F.row_number().over(w))
    rows = rows.withColumn("_first", F.min(F.when(c(label) == back, c("_k"))).over(whole))
    inside = c("_k").between(c("_first"), c("_first") + WINDOW - 1)
    lists = c("has_appendix_anchor") | c("has_list_of_exhibits") | c("has_list_of_schedules")
    ends = (c("_k") > c("_first")) & (c(signs) | ((c("relative_page") >= LATE) & lists))
    rows = rows.withColumns({
        "_place": F.max(F.when(c("_k") == c("_first"), c("relative_page"))).over(whole), "_signed": F.coalesce(F.max(F.when(c("_k") < c("_first"), c(label) == sig)).over(whole), F.lit(False)),
        "_body": F.avg(F.when(inside, (c("has_section_heading") | c("has_article_heading")).cast("int"))).over(whole), "_annexes": F.avg(F.when(inside, (c("has_annex_anchor") | lists).cast("int"))).over(whole),
        "_end": F.min(F.when(ends, c("_k"))).over(whole),
    })
    early = (c("_place") < EARLY) & ~c("_signed") & (c("_body") >= BODY_SHARE) & (c("_annexes") <= ANNEX_SHARE)
    run = early & (c("_k") >= c("_first")) & (c("_end").isNull() | (c("_k") < c("_end"))) & (c(label) == back)
    names = F.array(*[F.lit(x) for x in LABELS])
    rows = rows.withColumn("_once", F.when(run, LABELS[2]).otherwise(c(label)))
    highest = F.max(F.array_position(names, c("_once"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    settled = F.when(c("_first").isNull(), c(label)).otherwise(F.element_at(names, highest.cast("int")))
    rows = rows.withColumn("settled", settled)
    changed = F.when(c("_first").isNull(), F.lit(False)).otherwise((c("_once") != c(label)) | (c("settled") != c("_once")))
    return rows.withColumn("modified", changed).drop("_k", "_first", "_place", "_signed", "_body", "_annexes", "_end", "_once")
