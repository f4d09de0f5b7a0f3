"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import joins as J
from folioforge.operators import search
from folioforge.plans.registry import Tables, query


@query(
    "J1_composite_key_join",
    "SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_shipdate >= o_orderdate",
)
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.filter("l_shipdate >= o_orderdate").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


@query("J2_latest_ok", "SELECT o_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'O') ON l_orderkey = o_orderkey")
def _(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.filter("l_linenumber = 1 AND l_linestatus = 'O'").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query(
    "J3_left_joins_of_counts",
    """SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey""",
)
def _(t: Tables) -> DataFrame:
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))  # before the join, so that no order fans out
    lines = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("n_lines"))
    joined = J.counts_or_zero(J.counts_or_zero(t.customer, orders, ["c_custkey"], "n_orders"), lines, ["c_custkey"], "n_lines")
    return joined.select("c_custkey", "n_orders", "n_lines")


@query(
    "J4_star_of_aggregates",
    """SELECT n_nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers, coalesce(c.n, 0) AS orders FROM nation
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a ON a.k = n_nationkey
    LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON b.k = n_nationkey
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON c.k = n_nationkey""",
)
def _(t: Tables) -> DataFrame:
    out = t.nation.select("n_nationkey")
    for name, rows, key in (("customers", t.customer, "c_nationkey"), ("suppliers", t.supplier, "s_nationkey"), ("orders", t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey")):
        out = J.counts_or_zero(out, rows.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name)), ["n_nationkey"], name)
    return out


@query("J5_gaps", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("J6_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("J7_semi_join_by_name", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("J8_semi_join_two", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09) AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_tax > 0.07)")
def _(t: Tables) -> DataFrame:
    out = t.supplier
    for condition in ("l_discount > 0.09", "l_tax > 0.07"):
        out = out.join(t.lineitem.filter(condition).select("l_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return out.select("s_suppkey")


@query("J9_three_way", "SELECT s_name, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_name", "n_name").agg(F.count("*").alias("n"))


@query(
    "J10_regrouped_labels",
    "SELECT o_orderkey, list_sort(list_distinct(list(l_returnflag)))::VARCHAR[] AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("J11_hydration", "SELECT c_custkey, c_name, ordinal::INT AS ordinal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS ordinal FROM customer) WHERE ordinal <= 20")
def _(t: Tables) -> DataFrame:
    top = t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    ids = top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("ordinal"))
    return search.hydrate(ids, t.customer.select("c_custkey", "c_name"), "c_custkey")


@query("J12_scalar_count", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders")
def _(t: Tables) -> DataFrame:
    return J.counts_or_zero(t.orders.select("o_orderkey"), t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines")), ["o_orderkey"], "n_lines")


@query("J13_parent_chain", "SELECT c_custkey::BIGINT AS id, c_name AS label, n_name AS middle_label, r_name AS top_label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    leaf = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("parent_id"))
    middle = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("parent_id"))
    return J.parent_chain(leaf, middle, t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label")))


@query(
    "J14_code_labels",
    "SELECT p_partkey, coalesce(CASE WHEN p_size <= 24 THEN n_name END, CASE WHEN p_size <= 4 THEN r_name END, p_size::VARCHAR) AS label FROM part LEFT JOIN nation ON n_nationkey = p_size LEFT JOIN region ON r_regionkey = p_size",
)
def _(t: Tables) -> DataFrame:
    sector = t.region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    inner = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return J.label_of(t.part.select("p_partkey", "p_size"), "p_size", sector, inner).select("p_partkey", "label")


_WALK = "(VALUES ('31', '20'), ('311', '201'), ('3115', '2026'), ('32', '28'), ('325', '283'), ('33', '35'), ('3364', '372'), ('51', '73'), ('511', '737'), ('5', '60')) x(prefix, sic)"
_KINDS = "(VALUES ('2', 'goods'), ('28', 'chemicals'), ('283', 'drugs'), ('35', 'machines'), ('7', 'services'), ('737', 'software')) y(prefix, kind)"


@query(
    "J15_crosswalk",
    f"""WITH c AS (SELECT p_partkey, (300000 + p_partkey * 7919 % 230000)::VARCHAR AS naics FROM part), w AS (SELECT p_partkey, naics, (SELECT sic FROM {_WALK} WHERE starts_with(naics, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS sic FROM c)
    SELECT p_partkey, naics, sic, (SELECT kind FROM {_KINDS} WHERE starts_with(sic, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS class FROM w""",
)
def _(t: Tables) -> DataFrame:
    walk = t.spark.sql(f"SELECT * FROM {_WALK}")
    classes = t.spark.sql(f"SELECT prefix, kind AS class FROM {_KINDS}")
    codes = t.part.select("p_partkey", (300_000 + F.col("p_partkey") * 7919 % 230_000).cast("string").alias("naics"))
    return J.crosswalked(codes, "naics", walk, classes)


@query("J17_totals_and_hits", "SELECT year(o_orderdate)::INT AS y, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 400000) AS hits FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    totals = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("total"))
    hits = t.orders.filter("o_totalprice > 400000").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("hits"))
    return J.counts_or_zero(totals, hits, ["y"], "hits")


@query("J18_update_join", "SELECT o_orderkey, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))::INT AS gated FROM orders")
def _(t: Tables) -> DataFrame:
    flagged = t.lineitem.filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.with_flags(t.orders.select("o_orderkey"), flagged, ["o_orderkey"], "gated")


@query(
    "J19_fill_from_losers",
    """WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang FROM documents),
    s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS survivor FROM r),
    b AS (SELECT survivor, arg_min(lang, s.doc_id) AS l FROM s JOIN r USING (doc_id) WHERE s.doc_id <> survivor AND lang IS NOT NULL GROUP BY 1)
    SELECT r.doc_id, coalesce(lang, l) AS lang FROM r JOIN s ON s.doc_id = r.doc_id AND s.survivor = r.doc_id LEFT JOIN b ON b.survivor = r.doc_id""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    first = rows.groupBy("text").agg(F.min("doc_id").alias("survivor"))
    pairs = rows.join(first, "text").filter("doc_id <> survivor").select(F.col("doc_id").alias("loser"), "survivor")
    return J.fill_from_losers(rows, pairs, "doc_id", ["lang"]).select("doc_id", "lang")


@query("J20_versioned_id", "SELECT conv_id, turn FROM conversations WHERE turn = 1")
def _(t: Tables) -> DataFrame:
    requests = t.conversations.filter("turn = 1").select(F.concat_ws("::", "conv_id", "turn").alias("request"))
    page, version = J.versioned_id(F.col("request"))
    asked = requests.select(page.cast("long").alias("conv_id"), version.cast("long").alias("turn"))
    return t.conversations.join(asked, ["conv_id", "turn"]).select("conv_id", "turn")


@query("J21_struct_flatten", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k string").alias("metadata")).select("event_id", "metadata.*")
