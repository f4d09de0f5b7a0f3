"""Repairs of tagged headings: rules that rewrite <article> and <section> tags, each kept only if the structure gets better for it."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

from folioforge.operators.documents import SECTION, number, repair_accepted, violation_codes

HEADING = re.compile(r"<(article|section)>(.*?)</\1>", re.S | re.I)
PLACEHOLDER = r"\[?(?:intentionally omitted|reserved)\]?"
Gap = tuple[int, int, int]  # article, the section number that should come, the one that does


def tagged_xml(tagged: str | None) -> str:
    """Tagged text as a document: headings open articles and sections, what stands between is their text."""
    root = ET.Element("document")
    ET.SubElement(root, "frontMatter")
    body = ET.SubElement(root, "body")
    article = section = None
    at = 0

    def say(text: str) -> None:
        plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text).strip()
        home = section if section is not None else article if article is not None else root[0]
        if plain:
            ET.SubElement(home, "text").text = plain

    for m in HEADING.finditer(tagged or ""):
        say(tagged[at : m.start()])
        title = re.sub(r"\s+", " ", m[2]).strip()
        if m[1].lower() == "article":
            article, section = ET.SubElement(body, "article", title=title), None
        else:
            section = ET.SubElement(article if article is not None else body, "section", title=title)
        at = m.end()
    say((tagged or "")[at:])
    return ET.tostring(root, encoding="unicode")


def gaps(tagged: str) -> list[Gap]:
    """Where a section's number is above the one that should come."""
    out, last = [], {}
    for m in HEADING.finditer(tagged):
        n = SECTION.match(m[2].strip()) if m[1].lower() == "section" else None
        if n:
            article, got = int(n[1]), int(n[2])
            expected = last.get(article, 0) + 1
            if got > expected:
                out += [(article, k, got) for k in range(expected, got)]
            last[article] = got
    return out


def rewrite(tag: str, change: Callable[[str], str | None]) -> Callable[[str], str]:
    """A rule that gives what stands for a whole tag from its inner text, or None to leave it."""
    pattern = re.compile(rf"<{tag}>(.*?)</{tag}>", re.S | re.I)
    return lambda text: pattern.sub(lambda m: new if (new := change(m[1])) is not None else m[0], text)


def split_at(tag: str, inner: str, starts: list[int]) -> str | None:
    """The inner text as one tag for each start; None if there is nothing to split."""
    edges = [0, *[x for x in starts if inner[:x].strip()], len(inner)]
    parts = [inner[a:b].strip() for a, b in zip(edges, edges[1:])]
    return "\n\n".join(f"<{tag}>{p}</{tag}>" for p in parts) if len(parts) > 1 and all(parts) else None


def omitted_sections(inner: str) -> str | None:
    starts = [m.start() for m in re.finditer(rf"(?:Section\s+)?[0-9]+\.[0-9]+\b[.:\s-]*(?={PLACEHOLDER})", inner, re.I)]
    return split_at("section", inner, starts) if len(starts) > 1 else None


def omitted_articles(inner: str) -> str | None:
    starts = [m.start() for m in re.finditer(rf"ARTICLE\s+(?:[IVXLC]+|[0-9]+)\b[.:\s-]*(?={PLACEHOLDER})", inner, re.I)]
    return split_at("article", inner, starts) if len(starts) > 1 else None


def numbered(article: int, section: int) -> str:
    return rf"(?:Section\s+)?(?<![0-9.]){article}\.0?{section}(?![0-9.])"


def missing_inside(text: str) -> str:
    """A tag that holds the heading of a section that is missing is parted there."""
    wanted = gaps(text)
    if not wanted:
        return text
    pattern = re.compile("|".join(numbered(a, s) for a, s, _ in wanted), re.I)
    return rewrite("section", lambda inner: split_at("section", inner, [m.start() for m in pattern.finditer(inner)][:2]))(text)


def embedded_section(inner: str) -> str | None:
    """"3. TERMS 3.1 Scope" is an article and its first section."""
    m = re.match(r"\s*([0-9]+)\.?\s+(?![0-9]+\.)(\S.*?)\s+((?:Section\s+)?\1\.0?1\b.*)$", inner, re.S | re.I)
    return f"<article>ARTICLE {m[1]} {m[2].strip()}</article>\n\n<section>{m[3].strip()}</section>" if m else None


def promoted(text: str) -> str:
    """"<section>4. TERMS</section>" before a section 4.x is an article."""
    found = list(HEADING.finditer(text))
    out, at = [], 0
    for m, after in zip(found, [*found[1:], None]):
        whole = re.match(r"\s*([0-9]+)\.?\s+(?![0-9])(\S.*)$", m[2], re.S) if m[1].lower() == "section" else None
        if whole and after is not None and re.match(rf"\s*(?:Section\s+)?{whole[1]}\.[0-9]", after[2], re.I):
            out += [text[at : m.start()], f"<article>ARTICLE {whole[1]} {whole[2].strip()}</article>"]
            at = m.end()
    return "".join(out) + text[at:]


def inline_reference(text: str) -> str:
    """A tag around a reference within a sentence goes."""
    return re.sub(r"<section>(\s*(?:Section\s+)?[0-9]+\.[0-9]+\s*)</section>(\s*(?:of|and|or|to|above|below|hereof|shall|will|,|\)))", r"\1\2", text, flags=re.I)


def inserted(text: str) -> str:
    """A missing section's heading that starts a line without a tag gets one, to the line's end."""
    for article, section, _ in gaps(text):
        for m in re.finditer(rf"^[ \t]*({numbered(article, section)}[^\n<]*)$", text, re.M | re.I):
            before = text[: m.start()].lower()
            if all(before.rfind(f"<{t}>") <= before.rfind(f"</{t}>") for t in ("article", "section")):
                text = f"{text[: m.start(1)]}<section>{m[1].rstrip()}</section>{text[m.end(1) :]}"
                break
    return text


def wrapped_articles(text: str) -> str:
    """An article's heading without a tag right before its first section gets one."""

    def change(m: re.Match) -> str:
        same = number(m["n"]) == int(m["a"])
        return f"{m['before']}<article>{m['heading'].strip()}</article>{m['between']}{m['section']}" if same else m[0]

    heading = r"(?P<before>^|\n)(?P<heading>[ \t]*ARTICLE\s+(?P<n>[IVXLC]+|[0-9]+)\b[^\n<]*)(?P<between>\s+)(?P<section><section>\s*(?:Section\s+)?(?P<a>[0-9]+)\.0?1\b)"
    return re.sub(heading, change, text, flags=re.I)


#: The rules in the order they are tried.
RULES: dict[str, Callable[[str], str]] = {
    "split_omitted_sections": rewrite("section", omitted_sections),
    "split_omitted_articles": rewrite("article", omitted_articles),
    "split_missing_sections": missing_inside,
    "split_embedded_sections": rewrite("section", embedded_section),
    "promote_whole_numbers": promoted,
    "unwrap_bare_numbers": rewrite("section", lambda x: x if re.fullmatch(r"\s*[0-9]+(?:\.[0-9]+)?\.?\s*", x) else None),
    "unwrap_bare_labels": rewrite("section", lambda x: x if re.fullmatch(r"\s*(?:section|article)\s*", x, re.I) else None),
    "space_after_label": lambda text: re.sub(r"(<section>\s*Section)(?=[0-9])", r"\1 ", text, flags=re.I),
    "page_number_before_tag": lambda text: re.sub(r"<section>\s*([0-9]{1,3})\s+((?:Section\s+)[0-9]+\.[0-9]+[^<]*)</section>", r"\1 <section>\2</section>", text, flags=re.I),
    "unwrap_inline_references": inline_reference,
    "insert_missing_sections": inserted,
    "wrap_untagged_articles": wrapped_articles,
}


def repaired(tagged: str | None, least_articles: int = 5) -> dict:
    """text, applied (names of the rules that stay), before and after (numbers of violations): each rule is tried in turn on what is
    left by the ones before, and stays only if it brings no new code, makes none more frequent and leaves fewer in all."""
    text = tagged or ""
    codes = first = violation_codes(tagged_xml(text), least_articles)
    applied = []
    for name, rule in RULES.items():
        new = rule(text)
        if new != text and repair_accepted(codes, found := violation_codes(tagged_xml(new), least_articles)):
            text, codes = new, found
            applied.append(name)
    return {"text": text, "applied": applied, "before": len(first), "after": len(codes)}


REPAIRED = "struct<text:string,applied:array<string>,before:int,after:int>"
