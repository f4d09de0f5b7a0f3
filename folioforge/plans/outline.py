"""Outlines of tagged documents, and table functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import outline as O
from folioforge.plans.documents import structured
from folioforge.plans.registry import Tables, query

_LINES = """lines AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS ls FROM documents)),
made AS (SELECT doc_id, i, CASE WHEN doc_id % 7 = 0 AND i = 0 THEN s WHEN i % 8 = 0 THEN '<article>ARTICLE ' || (i // 8 + 1) || '  Terms</article>' || chr(10) || s WHEN i % 8 = 2 THEN '<section> Section ' || i || '.1 X </section>' || chr(10) || s
  WHEN i % 8 = 3 THEN '"Term ' || i || '" means ' || s WHEN i % 8 = 5 AND doc_id % 5 > 0 THEN '<pageUUID> p' || i || ' </pageUUID>' || chr(10) || s WHEN i % 8 = 6 THEN '“A' || i || '” or "B" as used shall mean ' || s WHEN i % 8 = 7 THEN '<page>' || i || '</page>' ELSE s END AS x FROM lines),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k, trim(x) AS x FROM (SELECT doc_id, i, unnest(string_split(x, chr(10))) AS x, generate_subscripts(string_split(x, chr(10)), 1) AS j FROM made) WHERE trim(x) <> ''),
named AS (SELECT doc_id, k, x, CASE WHEN starts_with(x, '<article>') THEN 'article' WHEN starts_with(x, '<section>') THEN 'section' WHEN starts_with(x, '<pageUUID>') THEN 'pageUUID' WHEN starts_with(x, '<page>') THEN 'page'
  WHEN regexp_matches(x, '(?i)^["“”][^"“”]+["“”]\\s+(?:mean|means|shall have the meaning|shall mean)\\b') OR regexp_matches(x, '(?i)^["“”][^"“”]+["“”](?:\\s+\\S+){0,5}\\s+(?:mean|means|shall mean|shall have the meaning)\\b') THEN 'definition' ELSE 'text' END AS kind FROM pieces),
valued AS (SELECT doc_id, k, kind, CASE WHEN kind IN ('definition', 'text') THEN x ELSE trim(regexp_replace(regexp_replace(x, '</?[A-Za-z]+>', '', 'g'), '\\s+', ' ', 'g')) END AS value, CASE WHEN kind = 'definition' THEN lower(regexp_extract(x, '^["“”]([^"“”]+)["“”]', 1)) END AS term FROM named),
placed AS (SELECT *, (SELECT count(*) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.k <= v.k AND a.kind = 'article') AS article_order, (SELECT max(a.k) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.k <= v.k AND a.kind = 'article') AS home FROM valued AS v),
full_rows AS (SELECT *, (SELECT count(*) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.k <= v.k AND a.kind = 'section' AND a.k > coalesce(v.home, -1)) AS section_order,
  (SELECT arg_max(a.value, a.k) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.k <= v.k AND a.kind = 'article') AS article_title, (SELECT arg_max(a.value, a.k) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.k <= v.k AND a.kind = 'section' AND a.k > coalesce(v.home, -1)) AS section_title,
  CASE WHEN kind IN ('article', 'section') THEN coalesce((SELECT arg_min(a.value, a.k) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.k > v.k AND a.kind = 'pageUUID'), (SELECT arg_max(a.value, a.k) FROM valued AS a WHERE a.doc_id = v.doc_id AND a.kind = 'pageUUID')) END AS page FROM placed AS v)"""


def tagged(t: Tables) -> DataFrame:
    """Documents whose lines become headings, definitions and page markers by turns; every fifth has no page markers."""
    d = F.col("doc_id")

    def line(s, i):
        m = i % 8
        head = F.when((d % 7 == 0) & (i == 0), s).when(m == 0, F.concat(F.lit("<article>ARTICLE "), (i / 8 + 1).cast("int"), F.lit("  Terms</article>\n"), s)).when(m == 2, F.concat(F.lit("<section> Section "), i, F.lit(".1 X </section>\n"), s))
        head = head.when(m == 3, F.concat(F.lit('"Term '), i, F.lit('" means '), s)).when((m == 5) & (d % 5 > 0), F.concat(F.lit("<pageUUID> p"), i, F.lit(" </pageUUID>\n"), s))
        return head.when(m == 6, F.concat(F.lit("“A"), i, F.lit('” or "B" as used shall mean '), s)).when(m == 7, F.concat(F.lit("<page>"), i, F.lit("</page>"))).otherwise(s)

    lines = F.filter(F.split("text", r"\n"), lambda s: F.trim(s) != "")
    return t.documents.select("doc_id", F.array_join(F.transform(lines, line), "\n").alias("tagged"))


@query("X8_outline", f"WITH {_LINES} SELECT doc_id, k::INT AS k, kind, value, term, article_order, article_title, section_order, section_title, CASE WHEN article_order = 0 AND section_order = 0 THEN 'frontMatter' ELSE 'body' END AS region, page FROM full_rows")
def _(t: Tables) -> DataFrame:
    return O.elements(tagged(t), "doc_id", "tagged")


@query(
    "X9_collapsed_definitions",
    f"""WITH {_LINES}, opened AS (SELECT *, (SELECT max(a.k) FROM full_rows AS a WHERE a.doc_id = v.doc_id AND a.k <= v.k AND a.kind = 'definition' AND a.article_order = v.article_order AND a.section_order = v.section_order) AS d FROM full_rows AS v),
    last_text AS (SELECT doc_id, d, max(k) AS last_k FROM opened WHERE kind = 'text' AND d IS NOT NULL GROUP BY 1, 2),
    moved AS (SELECT o.doc_id, o.d, list(o.kind || ': ' || o.value ORDER BY o.k) AS parts FROM opened AS o JOIN last_text AS l USING (doc_id, d) WHERE o.kind = 'text' OR (o.kind IN ('page', 'pageUUID') AND o.k <= l.last_k) GROUP BY 1, 2)
    SELECT f.doc_id, f.k::INT AS k, f.term, f.value AS text, coalesce(m.parts, []) AS parts FROM full_rows AS f LEFT JOIN moved AS m ON m.doc_id = f.doc_id AND m.d = f.k WHERE f.kind = 'definition'""",
)
def _(t: Tables) -> DataFrame:
    return O.collapsed_definitions(O.elements(tagged(t), "doc_id", "tagged"), "doc_id")


def lateral(t: Tables, docs: DataFrame, function: str, key: str, column: str) -> DataFrame:
    """key and the rows that a table function gives for each document, in SQL."""
    from folioforge.operators import tables

    tables.register(t.spark)
    return t.spark.sql(f"SELECT d.{key}, r.* FROM {{docs}} AS d, LATERAL {function}(d.{column}) AS r", docs=docs)


@query("X6_violation_table")
def _(t: Tables) -> DataFrame:
    return lateral(t, structured(t), "violations", "doc_id", "xml")


@query("X10_section_table")
def _(t: Tables) -> DataFrame:
    return lateral(t, structured(t), "sections", "doc_id", "xml")


@query("X11_clause_table")
def _(t: Tables) -> DataFrame:
    return lateral(t, t.documents, "clauses", "doc_id", "text")


@query("T7_page_table")
def _(t: Tables) -> DataFrame:
    return lateral(t, t.pages, "html_pages", "page_id", "html")
