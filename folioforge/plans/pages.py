"""Pages of documents: their layout, a page model trained on ordered rows, and the correction of what it predicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import crf
from folioforge.operators import pages as P
from folioforge.plans.registry import Tables, query


def laid_out(t: Tables) -> DataFrame:
    """Conversations as documents, their turns as pages."""
    return P.with_surroundings(P.with_layout(t.conversations, "conv_id", "turn", "text"), "conv_id", "turn")


def feature_columns(pages: DataFrame) -> list[str]:
    return [c for c, kind in pages.dtypes if c not in ("conv_id", "turn", "role", "text") and kind in ("double", "boolean")]


@query("T27_page_layout")
def _(t: Tables) -> DataFrame:
    """64 features of every turn."""
    pages = laid_out(t)
    return pages.select("conv_id", "turn", *[F.round(c, 8).alias(c) if dict(pages.dtypes)[c] == "double" else c for c in feature_columns(pages)])


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


@query("X20_page_crf")
def _(t: Tables) -> DataFrame:
    """conv_id, turn, role, predicted, held_out: a chain model of roles, learned from conversations that are not held out."""
    pages = laid_out(t).withColumn("held_out", held_out("conv_id"))
    features = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_columns(pages) if c != "held_out"])
    rows = pages.select("conv_id", "turn", "role", "held_out", features.alias("f"))
    model = crf.fit(rows.filter("NOT held_out"), "conv_id", "turn", F.col("f"), F.col("role"), ("system", "user", "assistant"))
    found = crf.predict(model, rows, "conv_id", "turn", F.col("f"))
    return rows.select("conv_id", "turn", "role", "held_out").join(found, ["conv_id", "turn"])


_PAGES = """SELECT source, doc_id, k, n, k / n AS relative_page, n_chars % 2 = 0 AS section, n_chars % 7 = 0 AS article, n_chars % 13 = 0 AS annex, n_chars % 17 = 0 AS appendix, n_chars % 19 = 0 AS exhibits,
    n_chars % 29 = 0 AS schedules, n_chars % 23 = 0 AS signs, CASE WHEN n_chars % 11 = 0 THEN 'back_matter' WHEN k / n < 0.1 THEN 'front_matter' WHEN k / n < 0.2 THEN 'toc' WHEN k / n < 0.7 THEN 'body'
    WHEN k / n < 0.75 THEN 'sig' WHEN length(source) % 2 = 0 THEN 'body' ELSE 'back_matter' END AS label
  FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)"""


@query(
    "W7_settled_labels",
    f"""
WITH p AS ({_PAGES}),
b AS (SELECT source, min(k) AS b FROM p WHERE label = 'back_matter' GROUP BY source),
span AS (
  SELECT source, b, avg((section OR article)::INT) AS body, avg((annex OR appendix OR exhibits OR schedules)::INT) AS annexes
  FROM p JOIN b USING (source) WHERE k >= b AND k < b + 16 GROUP BY source, b
), stops AS (SELECT source, min(k) AS stop FROM p JOIN b USING (source) WHERE k > b AND (signs OR (relative_page >= 0.75 AND (appendix OR exhibits OR schedules))) GROUP BY source),
early AS (
  SELECT source, b, coalesce(stop, 1000000000) AS stop FROM span LEFT JOIN stops USING (source)
  WHERE body >= 0.40 AND annexes <= 0.20 AND (SELECT relative_page FROM p WHERE p.source = span.source AND p.k = span.b) < 0.45
    AND NOT EXISTS (SELECT 1 FROM p WHERE p.source = span.source AND p.k < span.b AND label = 'sig')
), once AS (SELECT p.*, CASE WHEN e.b IS NOT NULL AND k >= e.b AND k < e.stop AND label = 'back_matter' THEN 'body' ELSE label END AS once FROM p LEFT JOIN early AS e USING (source)),
ranked AS (SELECT *, max(list_position(['front_matter', 'toc', 'body', 'sig', 'back_matter'], once)) OVER (PARTITION BY source ORDER BY k) AS highest FROM once)
SELECT source, doc_id, CASE WHEN b.source IS NULL THEN label ELSE ['front_matter', 'toc', 'body', 'sig', 'back_matter'][highest] END AS settled,
  CASE WHEN b.source IS NULL THEN FALSE ELSE once <> label OR ['front_matter', 'toc', 'body', 'sig', 'back_matter'][highest] <> once END AS modified
FROM ranked LEFT JOIN b USING (source)
""",
)
def _(t: Tables) -> DataFrame:
    """The documents of a source as the pages of one, with labels and layout made of their lengths."""
    whole = Window.partitionBy("source")
    n = F.col("n_chars")
    rows = t.documents.select("source", "doc_id", "n_chars", (F.row_number().over(whole.orderBy("doc_id")) / F.count("*").over(whole)).alias("relative_page"))
    flags = {"has_section_heading": 2, "has_article_heading": 7, "has_annex_anchor": 13, "has_appendix_anchor": 17, "has_list_of_exhibits": 19, "has_list_of_schedules": 29, "sig_context": 23}
    at = F.col("relative_page")
    label = F.when(n % 11 == 0, "back_matter").when(at < 0.1, "front_matter").when(at < 0.2, "toc").when(at < 0.7, "body").when(at < 0.75, "sig").when(F.length("source") % 2 == 0, "body").otherwise("back_matter")
    rows = rows.withColumns({c: n % m == 0 for c, m in flags.items()} | {"label": label})
    return P.settled_labels(rows, "source", "doc_id", "label").select("source", "doc_id", "settled", "modified")
