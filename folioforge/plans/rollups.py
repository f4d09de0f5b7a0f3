"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import rollups as R
from folioforge.plans.registry import Tables, query

DEALS = "SELECT o.*, year(o_orderdate)::INT AS y, c_mktsegment, c_nationkey FROM orders o JOIN customer ON o_custkey = c_custkey"


def deals(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("o_orderdate"))


@query("A1_counts_by_key", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "A2_wide_group_by",
    f"""SELECT y, o_orderstatus, o_orderpriority, c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT o_custkey) AS buyers,
    count(DISTINCT c_nationkey) AS nations, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS verified FROM ({DEALS}) GROUP BY 1, 2, 3, 4""",
)
def _(t: Tables) -> DataFrame:
    keys = ["y", "o_orderstatus", "o_orderpriority", "c_mktsegment"]
    return deals(t).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(R.money("o_totalprice")).cast("double").alias("total"), F.countDistinct("o_custkey").alias("buyers"),
        F.countDistinct("c_nationkey").alias("nations"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("verified"),
    )


@query("A3_status_by_year", f"SELECT y, o_orderstatus, count(*) AS n FROM ({DEALS}) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return deals(t).groupBy("y", "o_orderstatus").agg(F.count("*").alias("n"))


@query("A4_type_by_year", f"SELECT y, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'unknown') AS kind, count(*) AS n FROM ({DEALS}) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    kind = F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), F.lit("unknown"))
    return deals(t).groupBy("y", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "A5_overview",
    """SELECT count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, round(100.0::DOUBLE * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS pct,
    max(o_orderdate) AS latest, (SELECT count(*) FROM lineitem) AS lines FROM orders""",
)
def _(t: Tables) -> DataFrame:
    done = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    one = t.orders.agg(F.count("*").alias("n"), done.alias("done"), F.round(done * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct"), F.max("o_orderdate").alias("latest"))
    return one.crossJoin(t.lineitem.agg(F.count("*").alias("lines")))  # one row with one row


@query("A6_ownership_mix", f"SELECT y, c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM ({DEALS}) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return deals(t).groupBy("y", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(R.money("o_totalprice")).cast("double").alias("total"))


@query(
    "A7_deal_size_quantiles",
    f"""SELECT y, c_mktsegment, round(quantile_cont(o_totalprice, 0.25) FILTER (WHERE o_totalprice > 0), 4) AS p25, round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_totalprice > 0), 4) AS median,
    round(quantile_cont(o_totalprice, 0.75) FILTER (WHERE o_totalprice > 0), 4) AS p75 FROM ({DEALS}) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    out = R.quantiles(deals(t), ["y", "c_mktsegment"], "o_totalprice", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "median", "p75")})


@query(
    "A8_buyer_grid",
    f"""WITH g AS (SELECT * FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NO SUCH')) a(c_mktsegment), (VALUES ('F'), ('O'), ('X')) b(o_orderstatus)),
    d AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(median(o_totalprice) FILTER (WHERE o_totalprice > 0), 4) AS median FROM ({DEALS}) GROUP BY 1, 2)
    SELECT c_mktsegment, o_orderstatus, coalesce(n, 0) AS n, median FROM g LEFT JOIN d USING (c_mktsegment, o_orderstatus)""",
)
def _(t: Tables) -> DataFrame:
    grid = t.spark.createDataFrame([(a, b) for a in ("BUILDING", "MACHINERY", "NO SUCH") for b in ("F", "O", "X")], "c_mktsegment string, o_orderstatus string")
    keys = ["c_mktsegment", "o_orderstatus"]
    made = deals(t).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.percentile(F.when(F.col("o_totalprice") > 0, F.col("o_totalprice")), F.lit(0.5)), 4).alias("median"))
    return R.dense_grid(made, grid, keys, ["n"])


@query("A9_industry_by_year", f"SELECT y, CASE WHEN trim(c_mktsegment) = '' OR c_mktsegment = 'HOUSEHOLD' THEN 'Unspecified' ELSE c_mktsegment END AS industry, count(*) AS n FROM ({DEALS}) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    name = F.when((F.trim("c_mktsegment") == "") | (F.col("c_mktsegment") == "HOUSEHOLD"), "Unspecified").otherwise(F.col("c_mktsegment"))
    return deals(t).groupBy("y", name.alias("industry")).agg(F.count("*").alias("n"))


@query(
    "A10_industry_pairs",
    """SELECT s_nationkey, c_nationkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY n DESC, total DESC, 1, 2""",
)
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    out = lines.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"), F.sum(R.money("l_extendedprice")).cast("double").alias("total"))
    return out.orderBy(F.desc("n"), F.desc("total"), "s_nationkey", "c_nationkey")


@query(
    "A11_facet_counts",
    """SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def _(t: Tables) -> DataFrame:
    return R.facet_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "A12_field_coverage",
    """WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
    u AS (SELECT 'quality' AS field, lang = 'en' AS e, lang = 'en' AND quality IS NOT NULL AS c, lang AS scope FROM d UNION ALL SELECT 'toxic', TRUE, toxic IS NOT NULL, lang FROM d UNION ALL SELECT 'length', n_chars > 1000, n_chars > 1000 AND n_chars % 2 = 0, lang FROM d)
    SELECT scope, field, count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE c) AS covered, CASE WHEN count(*) FILTER (WHERE e) > 0 THEN round_even(count(*) FILTER (WHERE c) * 100.0::DOUBLE / count(*) FILTER (WHERE e), 1) END AS pct FROM u GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    d, c = t.documents.join(t.labels, "doc_id", "left"), F.col
    fields = {"quality": (c("lang") == "en", c("quality").isNotNull()), "toxic": (F.lit(True), c("toxic").isNotNull()), "length": (c("n_chars") > 1000, c("n_chars") % 2 == 0)}
    return R.coverage(d, fields, c("lang"))


@query("A13_leaderboard_counts", "SELECT s_name, year(o_orderdate)::INT AS y, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderdate IS NOT NULL GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("s_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).filter("y IS NOT NULL")


@query("A14_grouped_matches", "SELECT l_orderkey, count(*) AS matches, min(l_shipdate) AS first_ship, min(l_linenumber) AS first_line FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("matches"), F.min("l_shipdate").alias("first_ship"), F.min("l_linenumber").alias("first_line"))


@query("A15_having_conditions", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) >= 2")
def _(t: Tables) -> DataFrame:
    made = t.lineitem.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("l_quantity") > 20, 1).otherwise(0)).alias("q"))
    return made.filter("r = 0 AND q >= 2").select("l_orderkey")


@query("A16_stale", "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE m > o_orderdate + INTERVAL 90 DAY")
def _(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"))
    return t.orders.join(last, F.col("l_orderkey") == F.col("o_orderkey")).filter("m > o_orderdate + INTERVAL 90 DAY").select("o_orderkey")


@query(
    "A17_mode_name",
    """SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, length(lang) DESC, lower(lang), lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1""",
)
def _(t: Tables) -> DataFrame:
    return R.mode_name(t.documents, "source", "lang")


@query("A18_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type")


@query("A19_grand_totals", "SELECT count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n"), F.sum(R.money("l_quantity")).cast("double").alias("quantity"), F.sum(R.money("l_extendedprice")).cast("double").alias("price"))


@query("A20_distinct_on_page", "SELECT count(DISTINCT l_suppkey) AS n FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50)")
def _(t: Tables) -> DataFrame:
    return t.lineitem.orderBy("l_orderkey", "l_linenumber").limit(50).agg(F.countDistinct("l_suppkey").alias("n"))


_SLOT = "CASE " + " ".join(f"WHEN value <= {b} THEN {k}" for k, b in enumerate(R.LATENCY_BOUNDS)) + " ELSE 9 END"


@query(
    "A21_hourly_usage",
    f"""SELECT event_type, date_trunc('hour', ts) AS slot, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total, max(value) AS most,
    [{", ".join(f"count(*) FILTER (WHERE value IS NOT NULL AND ({_SLOT}) = {k})" for k in range(10))}] AS buckets FROM events GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return R.usage_rollup(t.events, ["event_type"], "ts", "value")


@query("A22_first_seen", "SELECT event_type, date_trunc('day', ts) AS d, user_id, min(ts) AS first_seen FROM events GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("d"), "user_id").agg(F.min("ts").alias("first_seen"))


@query("A23_usage_by_period", "SELECT date_trunc('day', ts) AS d, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 7 DAY FROM events) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    cutoff = t.events.agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 7 DAY")).alias("cutoff"))
    return t.events.crossJoin(F.broadcast(cutoff)).filter("ts >= cutoff").groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "A25_mined_rules",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS nx FROM c WINDOW w AS (PARTITION BY source ORDER BY n DESC, lang))
    SELECT source, lang, n, round(p, 6) AS precision, round(p - p * nx / n, 6) AS margin FROM r WHERE k = 1 AND n >= 3 AND p >= 0.3 AND p - p * nx / n >= 0.1""",
)
def _(t: Tables) -> DataFrame:
    return R.mined_rules(t.documents, "source", "lang", 3, 0.3, 0.1).withColumns({c: F.round(c, 6) for c in ("precision", "margin")})


@query("A26_prevalence", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)")
def _(t: Tables) -> DataFrame:
    return R.split_report(t.documents, "source", "lang").withColumn("share", F.round("share", 6))


@query(
    "A27_wilson",
    """WITH c AS (SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS h FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, h / n AS p FROM c)
    SELECT lang, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 8) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 8) AS high FROM p""",
)
def _(t: Tables) -> DataFrame:
    made = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.sum("quality").cast("double").alias("h"))
    low, high = R.wilson(F.col("h"), F.col("n"))
    return made.select("lang", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("A28_bootstrap")
def _(t: Tables) -> DataFrame:
    return R.bootstrap(t.documents.join(t.labels, "doc_id"), "lang", "quality")


@query("A29_phi", "SELECT lang, CASE WHEN min(quality) <> max(quality) AND min(toxic) <> max(toxic) THEN round(corr(quality, toxic), 8) END AS phi FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.phi(t.documents.join(t.labels, "doc_id"), ["lang"], "quality", "toxic").withColumn("phi", F.round("phi", 8))


@query("A30_pivot", "SELECT year(o_orderdate)::INT AS y, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s.lower()}_n" for s in "FOP") + " FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    made = t.orders.groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return made.select("y", *[F.coalesce(s, F.lit(0)).cast("long").alias(f"{s.lower()}_n") for s in "FOP"])


@query(
    "A31_class_metrics",
    """WITH p AS (SELECT lang AS a, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS b FROM documents), k AS (SELECT a AS label FROM p UNION SELECT b FROM p),
    m AS (SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS tp, count(*) FILTER (WHERE a <> label AND b = label) AS fp, count(*) FILTER (WHERE a = label AND b <> label) AS fn FROM k, p GROUP BY 1)
    SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 8) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM m""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("a"), F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("b"))
    return R.class_metrics(rows, "a", "b").withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query(
    "A34_threshold",
    """WITH s AS (SELECT n_chars AS threshold, count(*) AS n, sum(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    c AS (SELECT threshold, sum(n) OVER w AS flagged, sum(p) OVER w AS hits, sum(p) OVER () AS al FROM s WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT threshold, flagged::BIGINT AS flagged, hits::BIGINT AS hits, hits / flagged AS precision, hits / al AS recall FROM c)
    SELECT threshold, flagged, hits, round(precision, 8) AS precision, round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall), 8) AS f1, recall >= 0.9 AS feasible FROM m WHERE recall >= 0.9 ORDER BY flagged, precision DESC, threshold DESC LIMIT 1""",
)
def _(t: Tables) -> DataFrame:
    return R.best_threshold(t.documents.join(t.labels, "doc_id"), "n_chars", "quality", 0.9).withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query(
    "A25_pair_rules",
    """WITH c AS (SELECT l_shipmode_ AS a, l_linestatus AS b, l_returnflag, count(*) AS n FROM (SELECT l_linenumber % 4 AS l_shipmode_, * FROM lineitem) GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY a, b) AS p, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS nx FROM c WINDOW w AS (PARTITION BY a, b ORDER BY n DESC, l_returnflag))
    SELECT a, b, l_returnflag, n, round(p, 6) AS precision, round(p - p * nx / n, 6) AS margin FROM r WHERE k = 1 AND n >= 3 AND p >= 0.2""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_linenumber") % 4).alias("a"), F.col("l_linestatus").alias("b"), "l_returnflag")
    return R.mined_pair_rules(rows, "a", "b", "l_returnflag", 3, 0.2, -1.0).withColumns({c: F.round(c, 6) for c in ("precision", "margin")})


@query(
    "A31_average_metrics",
    """WITH p AS (SELECT lang AS a, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS b FROM documents), k AS (SELECT a AS label FROM p UNION SELECT b FROM p),
    m AS (SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS tp, count(*) FILTER (WHERE a <> label AND b = label) AS fp, count(*) FILTER (WHERE a = label AND b <> label) AS fn FROM k, p GROUP BY 1),
    c AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM m)
    SELECT round(sum(tp) / sum(tp + fn), 8) AS accuracy, round(avg(p), 8) AS macro_precision, round(avg(r), 8) AS macro_recall, round(avg(f), 8) AS macro_f1, round(sum(tp) / sum(tp + fp), 8) AS micro_precision, round(sum(tp) / sum(tp + fn), 8) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 8) AS micro_f1,
    round(sum(p * (tp + fn)) / sum(tp + fn), 8) AS weighted_precision, round(sum(r * (tp + fn)) / sum(tp + fn), 8) AS weighted_recall, round(sum(f * (tp + fn)) / sum(tp + fn), 8) AS weighted_f1 FROM c""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("a"), F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("b"))
    out = R.average_metrics(R.class_metrics(rows, "a", "b"))
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query(
    "A31_set_metrics",
    """WITH s AS (SELECT list_distinct([p_brand, p_type, CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END]) AS a, list_distinct([p_brand, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'other' END, CASE WHEN p_size > 20 THEN 'big' ELSE p_brand END]) AS b FROM part),
    n AS (SELECT len(a) AS t, len(b) AS g, len(list_intersect(a, b)) AS c FROM s)
    SELECT count(*) AS n, round(avg((t = c AND g = c)::INT), 8) AS subset_accuracy, round(sum(c) / sum(g), 8) AS micro_precision, round(sum(c) / sum(t), 8) AS micro_recall, round(2 * sum(c) / sum(t + g), 8) AS micro_f1 FROM n""",
)
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    truth = F.array("p_brand", "p_type", F.when(size > 25, "big").otherwise(F.col("p_brand")))
    guess = F.array("p_brand", F.when(size % 3 == 0, F.col("p_type")).otherwise("other"), F.when(size > 20, "big").otherwise(F.col("p_brand")))
    out = R.set_metrics(t.part.select(truth.alias("truth"), guess.alias("guess")), "truth", "guess")
    return out.select("n", *[F.round(c, 8).alias(c) for c in out.columns if c != "n"])
