"""Documents: HTML to text, pages, structure, validation, sections, clauses, redaction. One document at a time, in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.names import own

#: Fixed values of HTML: elements that begin a line, that show nothing, and that have no end tag.
BLOCKS = {"p", "div", "br", "tr", "li", "ul", "ol", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote", "title"}
SILENT = {"script", "style", "head", "noscript", "template"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BREAK = re.compile(r"page-break-(?:before|after)\s*:\s*always|break-(?:before|after)\s*:\s*page", re.I)
#: Reason codes of the structural checks.
REASONS = (
    "missing_body", "body_has_no_structural_children", "body_starts_non_article", "body_contains_non_article_children", "body_has_no_articles", "too_few_articles",
    "first_article_not_one", "section_title_invalid_numbering", "section_article_mismatch", "section_non_sequential", "too_many_empty_articles", "articles_out_of_order",
)
ARTICLE = re.compile(r"^\s*ARTICLE\s+([IVXLC]+|[0-9]+)\b[.:\s-]*(.*)$", re.I)
SECTION = re.compile(r"^\s*(?:Section\s+)?([0-9]+)\.([0-9]+)\b[.:\s-]*(.*)$", re.I)
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
INLINE = {"text", "page", "definition", "pageUUID"}


class _Text(HTMLParser):
    """Shown text with line ends at blocks, cells of a row apart by a bar, and a form feed at each page break outside tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent, self.open, self.tables = [], 0, [], 0

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        hidden = tag in SILENT or bool(HIDDEN.search(style)) or any(k == "hidden" for k, _ in attrs)
        if tag not in VOID:
            self.open.append((tag, hidden))
            self.silent += hidden
            self.tables += tag == "table"
        if self.silent:
            return
        if not self.tables and (BREAK.search(style) or tag == "hr"):
            self.out.append("\f")
        elif tag in BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th") and self.out and not self.out[-1].endswith("\n"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            was, hidden = self.open.pop()
            self.silent -= hidden
            self.tables -= was == "table"
            if was == tag:
                break
        if tag in BLOCKS and not self.silent:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def html_pages(html: str | None) -> list[str]:
    """The texts of an HTML document's pages; empty ones drop out."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    pages = []
    for part in "".join(parser.out).split("\f"):
        lines = [re.sub(r"[ \xa0]+", " ", line).strip() for line in part.split("\n")]
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
        if text:
            pages.append(text)
    return pages


def text_udf(make: Callable[[str | None], object], kind: str):
    """A function of one text as a column function, run in Arrow batches."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([make(x if isinstance(x, str) else None) for x in part], dtype=object)

    return run


def html_text(html: Column) -> Column:
    return text_udf(lambda x: "\n\n".join(html_pages(x)), "string")(html)


def split_text_pages(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, page_order, content of texts split at <PAGE>; empty parts drop out, but the orders of the others stay."""
    parts = rows.select(key, F.posexplode(F.split(text, "(?i)<PAGE>")).alias("page_order", "content"))
    return parts.withColumn("content", F.trim("content")).filter(F.col("content") != "")


def split_html_pages(rows: DataFrame, key: str, html: str) -> DataFrame:
    """key, page_order, content of HTML documents."""
    return rows.select(key, F.posexplode(text_udf(html_pages, "array<string>")(F.col(html))).alias("page_order", "content"))


def number(word: str | None) -> int | None:
    """The value of an Arabic or Roman number."""
    if not word:
        return None
    if word.isdigit():
        return int(word)
    values = [ROMAN[c] for c in word.upper() if c in ROMAN]
    if len(values) != len(word):
        return None
    return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def build_xml(text: str | None) -> str:
    """A document's articles and sections, by their headings, as XML; text before the first article is front matter."""
    root = ET.Element("document")
    front, body = ET.SubElement(root, "frontMatter"), ET.SubElement(root, "body")
    article = section = None
    orders = [0, 0]
    for line in (text or "").split("\n"):
        plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", line).strip()
        if not plain:
            continue
        if m := ARTICLE.match(plain):
            orders = [orders[0] + 1, 0]
            article, section = ET.SubElement(body, "article", title=plain, order=str(orders[0])), None
        elif article is not None and (m := SECTION.match(plain)):
            orders[1] += 1
            section = ET.SubElement(article, "section", title=plain, order=str(orders[1]))
        else:
            home = section if section is not None else article if article is not None else front
            ET.SubElement(home, "text").text = plain
    return ET.tostring(root, encoding="unicode")


def violations_of(xml: str | None, least_articles: int = 5) -> list[dict]:
    """code, detail and pages of each place where a document's structure breaks a rule, in the order of REASONS; xml_parse_failure alone
    if it does not parse. detail: the heading, and what was expected; pages: of the heading, where it has one."""
    whole = lambda code: [{"code": code, "detail": "", "pages": []}]
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return whole("xml_parse_failure")
    body = root.find("body")
    if body is None:
        return whole("missing_body")
    children = [c for c in body if c.tag not in INLINE]
    if not children:
        return whole("body_has_no_structural_children")
    found: list[dict] = []

    def broken(code: str, detail: str = "", *places: ET.Element) -> None:
        found.append({"code": code, "detail": detail, "pages": sorted({p.get("pageUUID") for p in places} - {None})})

    title = lambda e: e.get("title") or f"<{e.tag}>"
    if children[0].tag != "article":
        broken("body_starts_non_article", title(children[0]), children[0])
    for c in children:
        if c.tag != "article":
            broken("body_contains_non_article_children", title(c), c)
    articles = [c for c in children if c.tag == "article"]
    if not articles:
        broken("body_has_no_articles")
        return [f for r in REASONS for f in found if f["code"] == r]
    if len(articles) < least_articles:
        broken("too_few_articles", f"{len(articles)} of {least_articles}", *articles)
    numbers = [number(m[1]) if (m := ARTICLE.match(a.get("title", ""))) else None for a in articles]
    if numbers[0] != 1:
        broken("first_article_not_one", title(articles[0]), articles[0])
    most, empty = None, []
    for article, n in zip(articles, numbers):
        if n is not None:
            if most is not None and n <= most:
                broken("articles_out_of_order", f"{title(article)}: after {most}", article)
            else:
                most = n
        sections = article.findall("section")
        if not sections and not any((t.text or "").strip() for t in article.iter("text")):
            empty.append(article)
        expected = 1
        for s in sections:
            m = SECTION.match(s.get("title", ""))
            if not m:
                broken("section_title_invalid_numbering", title(s), s)
                continue
            if n is not None and int(m[1]) != n:
                broken("section_article_mismatch", f"{title(s)}: in article {n}", s)
            if int(m[2]) != expected:
                broken("section_non_sequential", f"{title(s)}: expected {m[1]}.{expected}", s)
            expected = int(m[2]) + 1
    if len(empty) > 1:
        broken("too_many_empty_articles", "; ".join(title(a) for a in empty), *empty)
    return [f for r in REASONS for f in found if f["code"] == r]


def violation_codes(xml: str | None, least_articles: int = 5) -> list[str]:
    """The codes of violations_of, one for each place."""
    return [f["code"] for f in violations_of(xml, least_articles)]


def structure_violations(xml: str | None, least_articles: int = 5) -> list[str]:
    """violation_codes, each once."""
    return list(dict.fromkeys(violation_codes(xml, least_articles)))


def repair_accepted(before: list[str], after: list[str]) -> bool:
    """A repair stands if it brings no new code, makes none more frequent and leaves fewer in all."""
    return len(after) < len(before) and all(after.count(c) <= before.count(c) for c in set(after))


def inner_text(element: ET.Element) -> str:
    return re.sub(r"\s+", " ", " ".join(element.itertext())).strip()


def sections_of(xml: str | None) -> list[dict]:
    """article_title, article_order, section_title, section_order, content of a document; an article's own text is a row without section."""
    try:
        body = ET.fromstring(xml or "").find(".//body")
    except ET.ParseError:
        return []
    out = []
    for article in [] if body is None else body.findall(".//article"):
        head = {"article_title": article.get("title", ""), "article_order": number(article.get("order"))}
        own = re.sub(r"\s+", " ", " ".join(inner_text(c) for c in article if c.tag != "section")).strip()
        if own:
            out.append(head | {"section_title": "", "section_order": None, "content": own})
        out += [head | {"section_title": s.get("title", ""), "section_order": number(s.get("order")), "content": inner_text(s)} for s in article.findall(".//section")]
    return out


SECTIONS = "array<struct<article_title:string,article_order:int,section_title:string,section_order:int,content:string>>"


def clauses_of(blocks: list[str] | None) -> list[dict]:
    """Clauses of a section's paragraphs: at enumerators (a), (b), ... in turn, each with what stands below it (1), (i) or further
    letters out of turn; without any, paragraphs, one that goes on where the one before stopped being part of it; without more than
    one of those, the whole section. method says which; start and stop are characters of the paragraphs joined by line ends."""
    places, at = [], 0
    for b in blocks or []:
        plain = (b or "").strip()
        if plain:
            low = at + (b or "").index(plain)
            places.append((plain, low, low + len(plain)))
        at += len(b or "") + 1
    out: list[tuple[str | None, list[tuple[str, int, int]]]] = []
    pending: list[tuple[str, int, int]] = []
    wanted = "a"
    for place in places:
        m = re.match(r"\(([a-z])\)", place[0])
        if m and m[1] == wanted:
            out.append((f"({wanted})", [*pending, place]))
            pending, wanted = [], chr(ord(wanted) + 1) if wanted < "z" else wanted
        elif out:
            out[-1][1].append(place)
        else:
            pending.append(place)
    method = "enumerated_split"
    if not out:
        for place in pending:
            before = out[-1][1][-1][0] if out else ""
            goes_on = out and (before[-1] not in ".?!\"'”’)]" or place[0][0].islower() or place[0][0] in ",;:)]")
            if goes_on:
                out[-1][1].append(place)
            else:
                out.append((None, [place]))
        method = "paragraph_split" if len(out) > 1 else "whole_section"
    return [{"anchor": a, "text": "\n\n".join(x for x, _, _ in t), "method": method, "start": t[0][1], "stop": t[-1][2]} for a, t in out]


CLAUSES = "array<struct<anchor:string,text:string,method:string,start:int,stop:int>>"


def redacted(rows: DataFrame, key: str, order: str, focus: Column, around: int, columns: list[str], instead: str = "[redacted]") -> DataFrame:
    """Rows within `around` of a focus row of their document keep their columns; in all others `instead` stands for them."""
    from pyspark.sql import Window

    f, close = own(rows, "_f", "_near")
    made = rows.withColumn(f, focus)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-around, around)
    made = made.withColumn(close, F.max(F.col(f).cast("int")).over(w) == 1)
    return made.withColumns({c: F.when(F.col(close), F.col(c)).otherwise(instead) for c in columns}).drop(f, close)


def definitions(text: Column) -> Column:
    """Terms in quotes before `means` or `shall mean`, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'[“"]([^”"\n]{2,80})[”"]\s+(?:means|shall mean)\b'), F.lit(1)))


def word_counts(xml: str | None) -> list[dict]:
    """region, words of a document: each top-level part, articles apart from the rest of the body."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out: dict[str, int] = {}
    for part in root:
        for child in part if part.tag == "body" else [part]:
            name = child.tag if part.tag == "body" else part.tag
            out[name] = out.get(name, 0) + len(inner_text(child).split())
    return [{"region": k, "words": v} for k, v in sorted(out.items())]


def with_standard_ids(xml: str | None, ids: dict[str, str] | None) -> str | None:
    """The document with standardId set on the sections whose uuid is among ids; one that does not parse stays as it is."""
    if not xml or not ids:
        return xml
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return xml
    for section in root.iter("section"):
        if section.get("uuid") in ids:
            section.set("standardId", ids[section.get("uuid")])
    return ET.tostring(root, encoding="unicode")


def write_standard_ids(docs: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """docs (key, xml) with the standard ids of assigned (key, uuid, standard_id) in their sections; of several for one section the least."""
    one = assigned.groupBy(key, "uuid").agg(F.min("standard_id").alias("id"))
    maps = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("uuid", "id"))).alias("_ids"))

    @F.pandas_udf("string")
    def apply(xml: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([with_standard_ids(x if isinstance(x, str) else None, dict(i) if i is not None else None) for x, i in zip(xml, ids)], dtype=object)

    return docs.join(maps, key, "left").withColumn("xml", apply("xml", F.col("_ids"))).drop("_ids")


def screen_table(html: str | None, width: int = 100) -> str:
    """A table of contents as lines for a screen: the cells of each row, the last one (a page number) at the right edge after dots;
    rows too long for that, and text outside tables, as they are."""
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    lines = []
    for cells in parser.rows:
        cells = [c for c in (re.sub(r"\s+", " ", x).strip() for x in cells) if c]
        if len(cells) > 1 and re.fullmatch(r"[0-9ivxlc-]+", cells[-1], re.I):
            left = "  ".join(cells[:-1])
            gap = width - len(left) - len(cells[-1]) - 2
            lines.append(f"{left} {'.' * gap} {cells[-1]}" if gap > 0 else f"{left} {cells[-1]}")
        elif cells:
            lines.append("  ".join(cells))
    return "\n".join(lines)


class _Rows(HTMLParser):
    """The cells of table rows; text outside rows is a row of one cell, parted at blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.inside, self.silent = [[""]], False, 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag == "tr":
            self.rows.append([""])
            self.inside = True
        elif tag in ("td", "th"):
            self.rows[-1].append("")
        elif tag in BLOCKS and not self.inside:
            self.rows.append([""])

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0
        if tag == "tr":
            self.inside = False
            self.rows.append([""])
        elif tag in BLOCKS and not self.inside:
            self.rows.append([""])

    def handle_data(self, data):
        if not self.silent:
            self.rows[-1][-1] += data


#: The labels of a signature block.
SIGNATURE_LABELS = ("by", "name", "title", "its", "date", "address")
LABELLED = re.compile(rf"^({'|'.join(SIGNATURE_LABELS)})\s*:\s*(.*)$", re.I)


def screen_signature(text: str | None) -> str:
    """A signature block for a screen: a line for each label with its value, "By: ____" where the value is a rule or missing, a blank
    line before each new signer."""
    lines = [re.sub(r"[^\S\n]+", " ", x).strip() for x in re.sub("[\u200b-\u200f\u202a-\u202e\u2060\ufeff]", "", text or "").splitlines()]
    lines = [re.sub(r"\s+([,.;:)\]])", r"\1", re.sub(r"([(\[])\s+", r"\1", x)) for x in lines if x]
    out, k = [], 0
    while k < len(lines):
        m = LABELLED.match(lines[k])
        if not m:
            if out and LABELLED.match(out[-1]):
                out.append("")
            out.append(lines[k])
        else:
            value = m[2]
            rule = k + 1 < len(lines) and not lines[k + 1].strip("_ -")
            if not value and k + 1 < len(lines) and not LABELLED.match(lines[k + 1]) and (m[1].lower() != "by" or rule):
                k += 1
                value = lines[k]
            out.append(f"{m[1].title()}: {value if value.strip('_ -') else '____'}")
        k += 1
    return "\n".join(out)
