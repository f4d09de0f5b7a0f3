"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import predicates as P
from folioforge.plans.registry import Tables, query

#: Price buckets on the scale of the test tables.
BUCKETS = {"low": (0.0, 50_000.0), "mid": (50_000.0, 200_000.0), "high": (200_000.0, None)}


@query("F1_year_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) IN (1993, 1996)")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(P.in_years(F.col("o_orderdate"), [1993, 1996])).select("o_orderkey", "o_orderdate")


@query("F2_date_bounds", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1997 AND o_orderdate >= TIMESTAMP '1993-06-01' AND o_orderdate < TIMESTAMP '1997-03-01'")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(P.between_dates(F.col("o_orderdate"), 1993, 1997, "1993-06-01", "1997-03-01")).select("o_orderkey")


@query("F3_facets", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(P.facets({"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_clerk": []})).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("F4_price_buckets", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice >= 0 AND o_totalprice < 50000) OR o_totalprice >= 200000")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(P.in_buckets(F.col("o_totalprice"), ["low", "high", "no such"], BUCKETS)).select("o_orderkey", "o_totalprice")


@query("F4_bucket_histogram", "SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(P.bucket_of(F.col("o_totalprice"), BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


@query("F5_tri_state", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def _(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").filter(P.flag_filter(F.col("toxic"), ["false", "maybe"])).select("doc_id")


@query(
    "F6_taxonomy_semi_join",
    """WITH ids AS (SELECT n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') UNION SELECT n_nationkey FROM nation WHERE n_nationkey = 3)
    SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM ids WHERE id = c_nationkey)""",
)
def _(t: Tables) -> DataFrame:
    from folioforge.operators.joins import expand_taxonomy

    nodes = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nodes = nodes.unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label")))
    asked = nodes.filter(F.col("label").isin("ASIA", "EUROPE") | (F.col("id") == "n3")).select("id")
    ids = expand_taxonomy(nodes, asked, depth=2)
    return t.customer.join(ids, F.concat(F.lit("n"), "c_nationkey") == F.col("id"), "left_semi").select("c_custkey")


@query("F7_exists_line", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_quantity > 45)")
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("F8_has_text", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def _(t: Tables) -> DataFrame:
    return t.documents.filter(P.has_text(F.col("text"))).select("doc_id")


@query("F9_json_empty", "SELECT count(*) AS n, count(*) FILTER (WHERE props IS NULL OR props IN ('', '[]')) AS n_empty FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.count_if(P.json_list_empty(F.col("props"))).alias("n_empty"))


@query("F10_prefix_search", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'pa')")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.search import prefix_search

    return prefix_search(t.part, "p_name", "PA").select("p_partkey", "p_name")


@query("F10_numeric_is_year", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.search import prefix_search

    return prefix_search(t.orders, "o_orderpriority", "1995", "o_orderdate").select("o_orderkey")


@query("F11_contains", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%'")
def _(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_mktsegment").ilike("%build%")).select("c_custkey")


@query("F12_title_regexp", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[0-9]*7$')")
def _(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").rlike("[0-9]*7$")).select("p_partkey")


_HEADINGS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' x ' WHEN 1 THEN NULL ELSE p_brand END AS article, CASE p_partkey % 7 WHEN 0 THEN p_name || ' [Reserved]' WHEN 1 THEN '[INTENTIONALLY DELETED] 2' WHEN 2 THEN NULL WHEN 3 THEN 'the [omitted] part' WHEN 4 THEN '[deleted]' WHEN 5 THEN 'intentionally omitted' ELSE p_name END AS section FROM part"


@query("F13_eligible_title", f"SELECT p_partkey FROM ({_HEADINGS}) WHERE length(trim(coalesce(article, ''))) >= 3 AND length(trim(coalesce(section, ''))) >= 3 AND NOT (lower(section) LIKE '%[reserved]%' OR lower(section) LIKE '%[omitted]%' OR lower(section) LIKE '%[intentionally deleted]%' OR lower(section) LIKE '%[deleted]%')")
def _(t: Tables) -> DataFrame:
    k, j = F.col("p_partkey") % 4, F.col("p_partkey") % 7
    article = F.when(k == 0, " x ").when(k == 1, None).otherwise(F.col("p_brand"))
    section = F.when(j == 0, F.concat("p_name", F.lit(" [Reserved]"))).when(j == 1, "[INTENTIONALLY DELETED] 2").when(j == 2, None).when(j == 3, "the [omitted] part").when(j == 4, "[deleted]").when(j == 5, "intentionally omitted").otherwise(F.col("p_name"))
    return t.part.filter(P.eligible_title(article, section)).select("p_partkey")


@query("F14_term_disjunction", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%licen%' OR source LIKE '%3%' OR lang IN ('de')")
def _(t: Tables) -> DataFrame:
    hit = F.lower("text").like("%licen%") | F.col("source").like("%3%") | F.arrays_overlap(F.array("lang"), F.array(F.lit("de")))
    return t.documents.filter(hit).select("doc_id")


@query("F15_word_signal", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^a-zA-Z0-9])([Tt][Hh][Ee]|[Uu][Nn][Dd])($|[^a-zA-Z0-9])')")
def _(t: Tables) -> DataFrame:
    return t.documents.filter(P.word_hit(F.col("text"), ["the", "und"])).select("doc_id")


_CORE = """SELECT o_orderkey, ['cash', 'stock', 'mixed', 'other', '  ', NULL][o_orderkey % 6 + 1] AS kind, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::VARCHAR END AS total, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '1' WHEN 2 THEN '2' END AS cash,
    CASE WHEN o_orderkey % 3 > 0 THEN '7' END AS stock, CASE WHEN o_orderstatus = 'F' THEN '9' END AS assets, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'public' END AS target, CASE WHEN o_orderkey % 13 > 0 THEN o_clerk END AS acquirer
    FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)"""


@query(
    "F16_missing_core",
    f"""SELECT o_orderkey FROM ({_CORE}) WHERE NOT (kind IS NOT NULL AND trim(kind) <> '') OR NOT (target IS NOT NULL AND trim(target) <> '') OR NOT (acquirer IS NOT NULL AND trim(acquirer) <> '')
    OR (coalesce(kind, '') = 'cash' AND (NOT (cash IS NOT NULL AND trim(cash) <> '') OR NOT (total IS NOT NULL AND trim(total) <> '')))
    OR (coalesce(kind, '') = 'stock' AND (NOT (stock IS NOT NULL AND trim(stock) <> '') OR NOT (total IS NOT NULL AND trim(total) <> '')))
    OR (coalesce(kind, '') = 'mixed' AND ((CASE WHEN cash IS NOT NULL AND trim(cash) <> '' THEN 1 ELSE 0 END + CASE WHEN stock IS NOT NULL AND trim(stock) <> '' THEN 1 ELSE 0 END + CASE WHEN assets IS NOT NULL AND trim(assets) <> '' THEN 1 ELSE 0 END) < 2 OR NOT (total IS NOT NULL AND trim(total) <> '')))""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("cash", "stock", "mixed", "other", "  ")], F.lit(None).cast("string")), (k % 6 + 1).cast("int"))
    total, cash = F.when(k % 5 > 0, F.col("o_totalprice").cast("string")), F.when(k % 4 == 0, " ").when(k % 4 == 1, "1").when(k % 4 == 2, "2")
    stock, assets = F.when(k % 3 > 0, "7"), F.when(F.col("o_orderstatus") == "F", "9")
    target, acquirer = F.when(k % 11 == 0, "").otherwise("public"), F.when(k % 13 > 0, F.col("o_orderpriority"))
    return t.orders.filter(P.missing_core(kind, total, cash, stock, assets, target, acquirer)).select("o_orderkey")


@query("F17_occurrences", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents WHERE (length(text) - length(replace(text, 'the', ''))) // 3 > 5")
def _(t: Tables) -> DataFrame:
    return t.documents.withColumn("n", P.occurrences(F.col("text"), "the")).filter("n > 5").select("doc_id", "n")


@query("F18_null_safe_difference", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM toxic")
def _(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").filter(P.differs(F.col("quality"), F.col("toxic"))).select("doc_id")


@query("F19_projection_keeps_key", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.search import project

    return project(t.orders, "o_orderkey", ["o_totalprice", "no_such_field"])


_OPENINGS = ("AGREEMENT and Plan of Merger ", "a business combination ", "amended membership interest purchase ", "Restated Agreement and Plan of Merger ", "other ")


@query(
    "F20_auto_verify",
    "SELECT doc_id FROM (SELECT doc_id, n_chars, lower(substring([" + ", ".join(f"'{x}'" for x in _OPENINGS) + """][doc_id % 5 + 1] || CASE WHEN doc_id % 7 = 0 THEN repeat('x', 480) ELSE '' END || text, 1, 500)) AS head FROM documents)
    WHERE n_chars // 100 >= 15 AND (contains(head, 'agreement and plan of merger') OR contains(head, 'business combination') OR contains(head, 'membership interest purchase')) AND NOT contains(head, 'amend') AND NOT contains(head, 'restate')""",
)
def _(t: Tables) -> DataFrame:
    from folioforge.functions.text import auto_verified

    opening = F.element_at(F.array(*[F.lit(x) for x in _OPENINGS]), (F.col("doc_id") % 5 + 1).cast("int"))
    said = F.concat(opening, F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("x"), 480)).otherwise(""), "text")
    return t.documents.filter(auto_verified(said, F.floor(F.col("n_chars") / 100))).select("doc_id")


@query("F21_sample_eligibility", "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 3 AND l_linenumber IS NOT NULL AND l_quantity BETWEEN 10 AND 40")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    lines = t.lineitem.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    return lines.filter((F.col("n") >= 3) & F.col("l_linenumber").isNotNull() & F.col("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber")


@query("F22_research_sample", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'purchase' AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t.events.filter((F.col("event_type") == "purchase") & (k >= 50)).select("event_id", k.alias("k"))


@query("F23_year_span", "SELECT min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.agg(F.year(F.min("o_orderdate")).alias("first_year"), F.year(F.max("o_orderdate")).alias("last_year"))


@query("F25_unknown_ids", "SELECT id, id IN (SELECT n_nationkey FROM nation) AS known FROM (VALUES (3), (7), (99), (100)) v(id)")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.search import resolve_ids

    asked = t.spark.createDataFrame([(3,), (7,), (99,), (100,)], "id int")
    return resolve_ids(asked, t.nation.select(F.col("n_nationkey").alias("id")))


@query("F26_default_context", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'F'")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.search import default_context

    return default_context(t.lineitem, "l_linestatus", "F", asked=False).select("l_orderkey", "l_linenumber")
