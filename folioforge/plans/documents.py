"""Documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import documents as D
from folioforge.operators import exhibits as X
from folioforge.plans.registry import Tables, query


def agreements(t: Tables) -> DataFrame:
    """Documents whose lines become headings by turns, so that they have a structure."""
    lines = F.filter(F.split("text", r"\n"), lambda s: F.trim(s) != "")
    headed = F.transform(lines, lambda s, i: F.when(i % 4 == 0, F.concat(F.lit("ARTICLE "), (i / 4 + 1).cast("int"), F.lit("\n"), s)).when(i % 4 == 1, F.concat(F.lit("Section "), (i / 4 + 1).cast("int"), F.lit(".1 Terms\n"), s)).otherwise(s))
    return t.documents.select("doc_id", F.array_join(headed, "\n").alias("text"))


def structured(t: Tables) -> DataFrame:
    return agreements(t).select("doc_id", D.text_udf(D.build_xml, "string")(F.col("text")).alias("xml"))


@query("T6_html_text")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", D.html_text(F.col("html")).alias("text"))


@query(
    "T7_text_pages",
    """SELECT doc_id, trim(x) AS content, k::INT - 1 AS page_order FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(replace(text, chr(10), '<page>') || '<page> <page>', '<page>') AS p FROM documents))
    WHERE trim(x) <> ''""",
)
def _(t: Tables) -> DataFrame:
    said = F.concat(F.replace("text", F.lit("\n"), F.lit("<Page>")), F.lit("<page> <PAGE>"))
    return D.split_text_pages(t.documents.select("doc_id", said.alias("text")), "doc_id", "text")


@query("T7_html_pages")
def _(t: Tables) -> DataFrame:
    return D.split_html_pages(t.pages, "page_id", "html")


@query("X6_violations")
def _(t: Tables) -> DataFrame:
    return structured(t).select("doc_id", F.explode(D.text_udf(D.structure_violations, "array<string>")(F.col("xml"))).alias("code"))


@query("X8_structure")
def _(t: Tables) -> DataFrame:
    return structured(t)


@query("X9_definitions", r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '(?m)^(\S+) (\S+) (\S+)', '"\1 \2" means \3'), '[“"]([^”"\n]{2,80})[”"]\s+(?:means|shall mean)\b', 1))) AS terms FROM documents""".replace("'\"\\1 \\2\" means \\3')", "'\"\\1 \\2\" means \\3', 'g')"))
def _(t: Tables) -> DataFrame:
    said = F.regexp_replace("text", r"(?m)^(\S+) (\S+) (\S+)", '"$1 $2" means $3')
    return t.documents.select("doc_id", F.array_sort(D.definitions(said)).alias("terms"))


@query("X10_sections")
def _(t: Tables) -> DataFrame:
    return structured(t).select("doc_id", F.explode(D.text_udf(D.sections_of, D.SECTIONS)(F.col("xml"))).alias("s")).select("doc_id", "s.*")


@query("X11_clauses")
def _(t: Tables) -> DataFrame:
    blocks = D.text_udf(lambda x: D.clauses_of((x or "").split("\n")), D.CLAUSES)
    return t.documents.select("doc_id", F.posexplode(blocks(F.col("text"))).alias("clause_order", "c")).select("doc_id", "clause_order", "c.*")


@query("X12_context_type", "SELECT doc_id, CASE WHEN lower(text) LIKE '%represent%' OR lower(text) LIKE '%warrant%' THEN 'rep_warranty' ELSE 'operative' END AS context FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.lower("text").rlike("represent|warrant"), "rep_warranty").otherwise("operative").alias("context"))


@query("X13_redaction", "SELECT conv_id, turn, CASE WHEN max((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 THEN text ELSE '[redacted]' END AS text FROM conversations")
def _(t: Tables) -> DataFrame:
    return D.redacted(t.conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn", F.col("role") == "system", 1, ["text"]).drop("role")


@query("X14_word_counts")
def _(t: Tables) -> DataFrame:
    counts = D.text_udf(D.word_counts, "array<struct<region:string,words:int>>")
    return structured(t).select("doc_id", F.explode(counts(F.col("xml"))).alias("c")).select("doc_id", "c.*")


def tagged(t: Tables) -> DataFrame:
    """Documents whose lines are headings by turns, some of them with the faults that repairs are for."""
    lines = F.filter(F.split("text", r"\n"), lambda s: F.trim(s) != "")
    k = F.col("doc_id") % 4

    def heading(s, i):
        n, first = (i / 4 + 1).cast("int"), F.element_at(F.split(s, " "), 1)
        article = F.concat(F.lit("<article>ARTICLE "), n, F.lit(" "), first, F.lit("</article>\n"), s)
        bare = F.concat(F.lit("ARTICLE "), n, F.lit(" "), first, F.lit("\n"))
        section = lambda m, tag: F.concat(F.lit(tag), n, F.lit(f".{m} "), first, F.lit("</section>\n"), s)
        faulty = F.when(k == 1, section(1, "<section>Section")).when(k == 2, section(1, "<section>7 Section ")).otherwise(section(1, "<section>Section "))
        return F.when(i % 4 == 0, F.when(k == 3, bare).otherwise(article)).when(i % 4 == 1, faulty).when(i % 4 == 2, section(2, "<section>Section ")).otherwise(s)

    return t.documents.select("doc_id", F.array_join(F.transform(lines, heading), "\n").alias("tagged"))


@query("X7_repairs")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.repairs import REPAIRED, repaired

    return tagged(t).select("doc_id", D.text_udf(lambda x: [repaired(x)], f"array<{REPAIRED}>")(F.col("tagged"))[0].alias("r")).select("doc_id", "r.*")


@query(
    "X15_standard_ids",
    """SELECT page_id, '<d><section uuid="a"' || CASE page_id % 3 WHEN 0 THEN ' standardId="s' || page_id % 5 || '"' ELSE '' END || '>x</section><section uuid="b"' || CASE WHEN page_id % 3 < 2 THEN ' standardId="t"' ELSE '' END || ' /></d>' AS xml FROM pages""",
)
def _(t: Tables) -> DataFrame:
    docs = t.pages.select("page_id", F.lit('<d><section uuid="a">x</section><section uuid="b"/></d>').alias("xml"))
    k = F.col("page_id")
    given = t.pages.filter(k % 3 == 0).select("page_id", F.lit("a").alias("uuid"), F.concat(F.lit("s"), k % 5).alias("standard_id"))
    given = given.unionByName(t.pages.filter(k % 3 < 2).select("page_id", F.lit("b").alias("uuid"), F.explode(F.array(F.lit("t"), F.lit("u"))).alias("standard_id")))
    return D.write_standard_ids(docs, given.unionByName(t.pages.select("page_id", F.lit("none").alias("uuid"), F.lit("x").alias("standard_id"))), "page_id")


@query("T28_screen_tables")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", D.text_udf(D.screen_table, "string")(F.col("html")).alias("screen"))


@query("T28_screen_signatures")
def _(t: Tables) -> DataFrame:
    block = F.concat(F.lit("By:\n____\nName: "), F.substring("text", 1, 20), F.lit("\nTitle:\n"), F.substring("text", 21, 12))
    return t.documents.select("doc_id", D.text_udf(D.screen_signature, "string")(block).alias("screen"))


_COUNT = "len(regexp_extract_all({where}, '\\b{p}\\b'))"


def _counts(where: str, phrases, upper: bool = False) -> str:
    return " + ".join(_COUNT.format(where=where, p=X.phrase_of(p).upper() if upper else X.phrase_of(p)) for p in phrases)


_HEADS = ("AGREEMENT AND PLAN OF MERGER of the MERGER SUB (mac). ", "EMPLOYMENT AGREEMENT and credit agreement; co-operation agreement amendment amendment ", "First: Stock-Purchase Agreement, go-shop, Amendments ", "", "Please See PDF Version: option warrant OPTIONS ")


@query(
    "T26_exhibit_features",
    "WITH m AS (SELECT doc_id, [" + ", ".join(f"'{h}'" for h in _HEADS) + r"""][doc_id % 5 + 1] || text AS text FROM documents),
    n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS w, trim(regexp_replace(substring(lower(text), 1, 2000), '[^a-z0-9]+', ' ', 'g')) AS r, trim(regexp_replace(substring(text, 1, 2000), '[^A-Za-z0-9]+', ' ', 'g')) AS c, len(regexp_extract_all(text, '\S+')) AS k FROM m),
    f AS (SELECT *, """
    + " + ".join(f"({_COUNT.format(where='w', p=X.phrase_of(p))} > 0)::INT" for p in X.SUBJECT) + " AS h, list_min(list_filter([" + ", ".join(f"instr(r, '{p}') - 1" for p in X.TITLES) + "], lambda x: x >= 0)) AS t, list_min(list_filter([" + ", ".join(f"instr(' ' || r || ' ', ' {X.phrase_of(p)} ') - 1" for p in X.AGAINST) + "], lambda x: x >= 0)) AS o, "
    + _counts("r", X.AGAINST) + " AS g, " + _counts("c", X.AGAINST, True) + """ AS u FROM n)
    SELECT doc_id, k::INT AS n_words, h::INT AS subject_hits, round(CASE WHEN k > 0 THEN h / k ELSE 0 END, 8) AS subject_density, (t IS NOT NULL)::INT AS title_hit, round(coalesce(t / greatest(1, length(r)), 0), 8) AS title_place, (g > 0)::INT AS against_hit, g::INT AS against_count,
    round(coalesce(o / greatest(1, length(r)), 0), 8) AS against_place, (u > 0)::INT AS against_caps, u::INT AS against_caps_count FROM f""",
)
def _(t: Tables) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 5 + 1).cast("int"))
    part = ("subject_density", "title_place", "against_place")
    made = X.featured(t.documents.select("doc_id", F.concat(head, "text").alias("made")), "made", None)
    return made.select("doc_id", *[F.round(c, 8).alias(c) if c in part else c for c in X.FEATURES])


@query("X19_likeness")
def _(t: Tables) -> DataFrame:
    """The largest, mean and median likeness of every document to the labelled ones."""
    from folioforge.operators import likeness

    like = likeness.fit(t.documents.join(t.labels.filter("quality IS NOT NULL").select("doc_id"), "doc_id"), "doc_id")
    found = likeness.with_likeness(t.documents, "doc_id", like)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in likeness.STATISTICS])


@query("X19_exhibit_classifier")
def _(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    return X.predict(X.fit(labelled, "doc_id"), t.documents, "doc_id", short=200)


@query("X20_model_slots", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'body' ELSE 'front_matter' END AS label, round(n_chars / (n_chars + 1000), 8) AS probability FROM documents")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.slots import register

    def load():
        import pandas as pd

        def predict(texts, sizes):
            return pd.Series([[{"label": "body" if n > 2000 else "front_matter", "probability": n / (n + 1000)}] for n in sizes])

        return predict

    register(t.spark, "page_classifier", load, "page_classifier")
    t.documents.createOrReplaceTempView("slot_documents")
    rows = t.spark.sql("SELECT doc_id, page_classifier(text, n_chars)[0] AS p FROM slot_documents")
    return rows.select("doc_id", "p.label", F.round("p.probability", 8).alias("probability"))
