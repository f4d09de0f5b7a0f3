"""The outline of tagged documents as rows: headings, page markers, definitions and text in order, each with the article, section and
page that it belongs to; and definitions with what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags of headings and of page markers.
HEADINGS, MARKERS = ("article", "section"), ("pageUUID", "page")
_ANY = "|".join((*HEADINGS, *MARKERS))
#: A tagged piece, over lines if need be; else what a line says up to the next.
PIECE = rf"(?s)<({_ANY})>.*?</\1>|(?:(?!<(?:{_ANY})>)[^\n])+"
#: How a definition begins: a term in quotes, or two with "or" between them, and up to five words later what it means.
_QUOTED = r"[“”\"][^\"“”]+[“”\"]"
_MEANS = r"\s+(?:mean|means|shall mean|shall have the meaning)\b"
DEFINES = rf"(?i)^(?:{_QUOTED}{_MEANS}|{_QUOTED}\s+or\s+{_QUOTED}{_MEANS}|{_QUOTED}(?:\s+\S+){{0,5}}{_MEANS})"


def _kind(piece: Column) -> Column:
    kind = F.when(piece.rlike(DEFINES), "definition").otherwise("text")
    for tag in (*HEADINGS, *MARKERS):
        kind = F.when(piece.rlike(rf"(?s)^<{tag}>.*</{tag}>$"), tag).otherwise(kind)
    return kind


def elements(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, kind (article, section, pageUUID, page, definition, text), value, term, article_order, article_title, section_order,
    section_title, region (frontMatter or body) and page of each piece of each text, in order.

    value: what is between the tags, of headings with white space collapsed; term: a definition's first term in lower case. Sections are
    counted within their article, and before the first article on their own (article_order 0). page, of headings: the first page marker
    with a value after the heading, else the document's last; null if it has none. A document is one sorted run of rows.
    """
    pieces = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    said = rows.select(key, F.posexplode(pieces).alias("k", "_x")).withColumn("kind", _kind(F.col("_x")))
    c, w = F.col, Window.partitionBy(key).orderBy("k")
    inner = F.regexp_replace(c("_x"), r"(?s)^<[A-Za-z]+>\s*|\s*</[A-Za-z]+>$", "")
    value = F.when(c("kind").isin(*HEADINGS), F.trim(F.regexp_replace(inner, r"\s+", " "))).when(c("kind").isin(*MARKERS), F.trim(inner)).otherwise(c("_x"))
    term = F.when(c("kind") == "definition", F.lower(F.regexp_extract("_x", r"^[“”\"]([^\"“”]+)[“”\"]", 1)))
    said = said.withColumns({"value": value, "term": term})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind, window: F.sum((c("kind") == kind).cast("int")).over(window)
    said = said.withColumns({"article_order": count("article", so_far), "article_title": F.last(F.when(c("kind") == "article", c("value")), ignorenulls=True).over(so_far)})
    inside = Window.partitionBy(key, "article_order").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumns({"section_order": count("section", inside), "section_title": F.last(F.when(c("kind") == "section", c("value")), ignorenulls=True).over(inside)})
    marker = F.when((c("kind") == "pageUUID") & (c("value") != ""), c("value"))
    after = F.first(marker, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = F.last(marker, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    region = F.when((c("article_order") == 0) & (c("section_order") == 0), "frontMatter").otherwise("body")
    said = said.withColumns({"region": region, "page": F.when(c("kind").isin(*HEADINGS), F.coalesce(after, last))})
    return said.select(key, "k", "kind", "value", "term", "article_order", "article_title", "section_order", "section_title", "region", "page")


def collapsed_definitions(outline: DataFrame, key: str) -> DataFrame:
    """key, k, term, text, parts of each definition: parts are the kinds and values of what goes into it, in order.

    Into a definition goes the text after it, up to the next one in the same section or article, and of the page markers among it
    those before its last text. outline: what `elements` gives."""
    c, home = F.col, [key, "region", "article_order", "section_order"]
    open_def = F.last(F.when(c("kind") == "definition", c("k")), ignorenulls=True).over(Window.partitionBy(*home).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    run = outline.withColumn("_d", open_def).filter(c("_d").isNotNull())
    run = run.withColumn("_last", F.max(F.when(c("kind") == "text", c("k"))).over(Window.partitionBy(key, "_d")))
    moved = (c("kind") == "text") | (c("kind").isin(*MARKERS) & (c("k") <= c("_last")))
    parts = F.array_sort(F.collect_list(F.when(moved, F.struct("k", "kind", "value"))))
    found = run.groupBy(key, c("_d").alias("k")).agg(F.max(F.when(c("kind") == "definition", c("term"))).alias("term"), F.max(F.when(c("kind") == "definition", c("value"))).alias("text"), parts.alias("_p"))
    return found.select(key, "k", "term", "text", F.transform("_p", lambda p: F.concat(p["kind"], F.lit(": "), p["value"])).alias("parts"))
