"""Sorting, limits, top-k and pages; set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import search as S
from folioforge.operators import sets
from folioforge.plans.registry import Tables, query


@query("L1_offset_page", "SELECT o_orderkey, TRUE AS has_next FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t: Tables) -> DataFrame:
    return S.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25).select("o_orderkey", "has_next")


@query(
    "L2_keyset_page",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN n_chars END AS v FROM documents)
    SELECT doc_id, v FROM (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, doc_id) AS k FROM r) WHERE k BETWEEN 42 AND 61""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars")).alias("v"))
    order = S.keyset_order("v", "doc_id", True)
    value, key = S.decode_cursor(S.encode_cursor(*rows.orderBy(*order).limit(41).offset(40).select("v", "doc_id").first()))
    return rows.filter(S.keyset_after("v", "doc_id", True, value, key)).orderBy(*order).limit(20)


@query("L3_queue_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'O' ORDER BY 1 LIMIT 50")
def _(t: Tables) -> DataFrame:
    return S.queue(t.orders.filter("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", 100, 50)


@query(
    "L4_dual_leaderboard",
    """WITH g AS (SELECT year(o_orderdate)::INT AS y, s_name, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, v DESC, s_name) AS by_count, row_number() OVER (PARTITION BY y ORDER BY v DESC, n DESC, s_name) AS by_value FROM g)
    SELECT y, s_name, n, v::DOUBLE AS v, by_count::INT AS by_count, by_value::INT AS by_value FROM r WHERE by_count <= 5 OR by_value <= 5""",
)
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    made = lines.groupBy(F.year("o_orderdate").alias("y"), "s_name").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    ranks = {"by_count": [F.desc("n"), F.desc("v"), "s_name"], "by_value": [F.desc("v"), F.desc("n"), "s_name"]}
    return S.top_by(made, ["y"], ranks, 5).withColumn("v", F.col("v").cast("double"))


@query("L5_top_candidates", "SELECT DISTINCT id FROM (SELECT p_partkey::VARCHAR AS id FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) UNION ALL SELECT p_brand FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30))")
def _(t: Tables) -> DataFrame:
    top = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(30)
    return top.select(F.col("p_partkey").cast("string").alias("id")).unionByName(top.select(F.col("p_brand").alias("id"))).distinct()


@query("L6_priority_order", "SELECT o_orderkey FROM orders ORDER BY (o_orderstatus <> 'P')::INT, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 40")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy((F.col("o_orderstatus") != "P").cast("int"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("L7_count_strategies", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS exact, (3 - 1) * 25 + 25 + 1 AS at_least")
def _(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").agg(F.count("*").alias("exact")).withColumn("at_least", F.lit(S.lower_bound(3, 25, 25, True)))


@query("L9_budget_prefix", "SELECT doc_id, so_far::BIGINT AS so_far FROM (SELECT *, sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM documents) WHERE so_far <= 100000")
def _(t: Tables) -> DataFrame:
    return S.budget_prefix(t.documents.select("doc_id", "n_chars"), "n_chars", [F.asc("n_chars"), F.asc("doc_id")], "n_chars", 100_000).select("doc_id", "so_far")


@query("L10_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '/7'), o_orderkey LIMIT 100")
def _(t: Tables) -> DataFrame:
    return S.seeded_sample(t.orders.select("o_orderkey"), "o_orderkey", 7, 100)


@query("L11_stratified_split", "SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents")
def _(t: Tables) -> DataFrame:
    return sets.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id", {"train": 8, "test": 2})


@query(
    "L12_capped_groups",
    """SELECT l_orderkey, l_linenumber, total_count, matched_count, matched_count > 2 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total_count, count(*) FILTER (WHERE l_quantity > 10) OVER (PARTITION BY l_orderkey) AS matched_count,
    row_number() OVER (PARTITION BY l_orderkey, l_quantity > 10 ORDER BY l_linenumber) AS r FROM lineitem) WHERE l_quantity > 10 AND r <= 2""",
)
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return S.capped_groups(lines, "l_orderkey", [F.asc("l_linenumber")], 2, F.col("l_quantity") > 10).drop("l_quantity")


@query("L13_mixed_order", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_shipdate, l_linenumber LIMIT 60")
def _(t: Tables) -> DataFrame:
    return t.lineitem.orderBy(F.desc("l_orderkey"), "l_shipdate", "l_linenumber").limit(60).select("l_orderkey", "l_linenumber")


@query("U1_tagged_union", "SELECT 'customer' AS scope, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.lit("customer").alias("scope"), F.col("c_custkey").alias("id")).unionByName(t.supplier.select(F.lit("supplier").alias("scope"), F.col("s_suppkey").alias("id")))


@query("U2_set_differences", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.filter("s_suppkey % 3 = 0").select("s_nationkey"))


@query("U3_grouped_pairs", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders UNION ALL SELECT 10000000 + o_custkey, min(o_orderkey) FROM orders GROUP BY o_custkey")
def _(t: Tables) -> DataFrame:
    # orders and their customers: as many groups as customers that order
    return sets.grouped(t.orders.select(F.col("o_orderkey").alias("a"), (10_000_000 + F.col("o_custkey")).alias("b")))


@query("U4_pair_set", "SELECT DISTINCT least(o_custkey % 50, o_orderkey % 50) AS a, greatest(o_custkey % 50, o_orderkey % 50) AS b FROM orders WHERE o_custkey % 50 <> o_orderkey % 50")
def _(t: Tables) -> DataFrame:
    return sets.unordered_pairs(t.orders.select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b")))


@query("U5_drift", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS drift FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def _(t: Tables) -> DataFrame:
    return sets.drift(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")




@query("L11_multilabel_split")
def _(t: Tables) -> DataFrame:
    """A fifth of the documents, with the shares of language, source and kind of length that all have."""
    from folioforge.operators.splits import multilabel_split

    labels = F.array_compact(F.array("lang", "source", F.when(F.col("n_chars") > 3000, "long"), F.when(F.col("doc_id") % 97 == 0, "rare")))
    return multilabel_split(t.documents.select("doc_id", labels.alias("labels")), "doc_id", "labels", 0.2)


@query(
    "L11_backed_off_strata",
    """WITH f AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS a, count(*) OVER (PARTITION BY lang) AS b FROM documents)
    SELECT doc_id, CASE WHEN a >= 8 THEN 0 WHEN b >= 8 THEN 1 ELSE 2 END AS level, CASE WHEN a >= 8 THEN coalesce(lang, '') || '|' || coalesce(source, '') WHEN b >= 8 THEN coalesce(lang, '') ELSE '' END AS stratum FROM f""",
)
def _(t: Tables) -> DataFrame:
    from folioforge.operators.splits import backed_off

    return backed_off(t.documents.select("doc_id", "lang", "source"), [["lang", "source"], ["lang"]], 8).select("doc_id", "level", "stratum")
