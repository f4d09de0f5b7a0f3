"""Near duplicates, retrieval and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import near_duplicates as N
from folioforge.operators import retrieval as R
from folioforge.plans.registry import Tables, query


@query("X4_survivors", "SELECT a, b, CASE WHEN (b_new AND NOT (pb < 0.5 * pa)) OR (NOT b_new AND pa < 0.5 * pb) THEN b ELSE a END AS survivor FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n_chars AS pa, y.n_chars AS pb, y.n_chars % 7 >= x.n_chars % 7 AS b_new FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)")
def _(t: Tables) -> DataFrame:
    a = t.documents.select(F.col("doc_id").alias("a"), F.col("n_chars").alias("pa"))
    b = t.documents.select(F.col("doc_id").alias("b"), F.col("n_chars").alias("pb"))
    c = F.col
    return a.join(b, c("b") == c("a") + 1).select("a", "b", N.survivor(c("pa") % 7, c("pa"), c("a"), c("pb") % 7, c("pb"), c("b")).alias("survivor"))


@query("X5_party_conflict", "SELECT n_nationkey, n_regionkey > 0 AND n_nationkey % 5 <> n_regionkey AS conflict FROM nation")
def _(t: Tables) -> DataFrame:
    name = lambda c: F.array(F.concat(F.lit("P"), c.cast("string")))
    left = F.when(F.col("n_regionkey") > 0, name(F.col("n_regionkey"))).otherwise(F.array().cast("array<string>"))
    return t.nation.select("n_nationkey", N.party_conflict(left, name(F.col("n_nationkey") % 5)).alias("conflict"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(
    "M5_bm25",
    f"""WITH d AS (SELECT doc_id, list_filter({_TOKENS}, lambda x: length(x) > 1) AS w FROM documents), q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({_TOKENS}, lambda x: length(x) > 1))) AS term FROM benchmark),
    p AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d), f AS (SELECT doc_id, size, term, count(*) AS tf FROM p GROUP BY ALL), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), i AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
    SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 5) AS score FROM q JOIN f USING (term) JOIN i USING (term), c GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", T.bm25_tokens(F.col("text")).alias("tokens"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), T.bm25_tokens(F.col("text")).alias("tokens"))
    return R.bm25(docs, asked).withColumn("score", F.round("score", 5))


_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("M4_cosine_top", f"SELECT a.vec_id AS query_id, b.vec_id, round({_COSINE}, 8) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10")
def _(t: Tables) -> DataFrame:
    asked = t.embeddings.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return R.cosine_top(asked, t.embeddings, 10).withColumn("cosine", F.round("cosine", 8))


@query("M4_centroids", "SELECT label, pos::INT - 1 AS pos, round(avg(x), 8) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return R.centroids(t.embeddings, "label").withColumn("mean", F.round("mean", 8))


@query(
    "M6_fusion",
    """WITH s AS (SELECT s_nationkey AS query_id, s_suppkey AS id, s_acctbal AS a, s_suppkey % 13 AS b, s_suppkey % 7 AS c FROM supplier),
    z AS (SELECT query_id, id, """ + ", ".join(f"CASE WHEN max({x}) OVER w > min({x}) OVER w THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0 END AS {x}" for x in "abc") + """ FROM s WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, id, round(0.55::DOUBLE * a + 0.3::DOUBLE * b + 0.15::DOUBLE * c, 8) AS score FROM z""",
)
def _(t: Tables) -> DataFrame:
    signals = t.supplier.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("dense"), (F.col("s_suppkey") % 13).cast("double").alias("lexical"), (F.col("s_suppkey") % 7).cast("double").alias("overlap"))
    return R.fused(signals).withColumn("score", F.round("score", 8))


@query(
    "A32_recall",
    "WITH g AS (SELECT o_custkey AS query_id, max(o_orderkey) AS id FROM orders GROUP BY 1), r AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT count(*) AS queries, round(avg((rank <= 5)::INT), 8) AS recall, round(avg(CASE WHEN rank <= 5 THEN 1 / rank ELSE 0 END), 8) AS mrr FROM g JOIN r USING (query_id, id)",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    gold = t.orders.groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_orderkey").alias("id"))
    ranked = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    return R.recall_at(ranked, gold, 5).withColumns({c: F.round(c, 8) for c in ("recall", "mrr")})


_BIGRAMS = "SELECT doc_id, source, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS phrase FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)"


@query("X16_phrase_counts", f"SELECT phrase, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM ({_BIGRAMS}) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5")
def _(t: Tables) -> DataFrame:
    return R.phrase_counts(t.documents, _bigrams(), 5)


def _bigrams():
    return T.ngrams(F.col("text"), 2, 2, ("",))


@query(
    "X17_phrase_shift",
    f"""WITH p AS (SELECT DISTINCT doc_id, doc_id % 3 AS k, phrase FROM ({_BIGRAMS})), n AS (SELECT doc_id % 3 AS k, count(*) AS total FROM documents GROUP BY 1),
    s AS (SELECT phrase, count(*) AS docs, """ + ", ".join(f"count(*) FILTER (WHERE k = {k}) / (SELECT total FROM n WHERE k = {k}) AS share_{k}" for k in range(3)) + """ FROM p GROUP BY 1)
    SELECT phrase, docs, round(share_0, 8) AS share_0, round(share_1, 8) AS share_1, round(share_2, 8) AS share_2, round(share_2 - share_0, 8) AS effect, CASE WHEN share_1 >= share_0 AND share_2 >= share_1 THEN 'rising' WHEN share_1 <= share_0 AND share_2 <= share_1 THEN 'falling' ELSE 'mixed' END AS shape
    FROM s WHERE docs >= 8 AND greatest(share_0, share_1, share_2) >= 0.05 AND abs(share_2 - share_0) >= 0.02""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("k", F.col("doc_id") % 3)
    out = R.phrase_shift(rows, "k", [0, 1, 2], _bigrams(), 8, 0.05, 0.02)
    return out.withColumns({c: F.round(c, 8) for c in ("share_0", "share_1", "share_2", "effect")})


_DOT = "list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e)))"
_WORDS = f"list_filter({_TOKENS}, lambda x: length(x) > 1)"
_TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')[1:5])"


@query(
    "X18_hybrid_top",
    f"""WITH d AS (SELECT doc_id, text, embedding::DOUBLE[] AS e, {_WORDS} AS w FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT * FROM d WHERE doc_id % 100 = 0),
    c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), f AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY ALL), i AS (SELECT term, count(*) AS df FROM f GROUP BY 1), k AS (SELECT doc_id AS query_id, unnest(list_distinct(w)) AS term FROM q),
    l AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS lexical FROM k JOIN f USING (term) JOIN i USING (term), c GROUP BY 1, 2),
    o AS (SELECT q.doc_id AS query_id, t.doc_id, least(count(*), 3) AS hits FROM q JOIN (SELECT doc_id, unnest({_TERMS}) AS term FROM d) t ON contains(lower(q.text), t.term) GROUP BY 1, 2),
    s AS (SELECT x.doc_id AS query_id, y.doc_id AS id, {_DOT} AS dense, coalesce(lexical, 0) AS lexical, coalesce(hits, 0)::DOUBLE AS overlap FROM q x CROSS JOIN d y LEFT JOIN l ON l.query_id = x.doc_id AND l.doc_id = y.doc_id LEFT JOIN o ON o.query_id = x.doc_id AND o.doc_id = y.doc_id),
    z AS (SELECT query_id, id, """ + ", ".join(f"CASE WHEN max({x}) OVER w > min({x}) OVER w THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0 END AS {x}" for x in ("dense", "lexical", "overlap")) + """ FROM s WINDOW w AS (PARTITION BY query_id)),
    r AS (SELECT query_id, id, 0.55::DOUBLE * dense + 0.3::DOUBLE * lexical + 0.15::DOUBLE * overlap AS score, row_number() OVER (PARTITION BY query_id ORDER BY 0.55::DOUBLE * dense + 0.3::DOUBLE * lexical + 0.15::DOUBLE * overlap DESC, id)::INT AS rank FROM z)
    SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 20""",
)
def _(t: Tables) -> DataFrame:
    both = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"))
    terms = F.array_distinct(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)), 1, 5))
    nodes = both.select(F.col("doc_id").alias("id"), "embedding", F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1).alias("tokens"), terms.alias("terms"), F.lower("text").alias("haystack"))
    queries = nodes.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return R.hybrid_top(queries, nodes, 20).withColumn("score", F.round("score", 5))


@query(
    "X18_with_parents",
    """WITH t AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3)
    SELECT query_id, id, score, rank, FALSE AS backoff FROM t UNION ALL SELECT query_id, -1 - id % 10, max(score), NULL, TRUE FROM t WHERE id % 10 > 2 GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), rank.alias("rank")).filter("rank <= 3")
    parents = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 > 2, -1 - F.col("o_orderkey") % 10).alias("parent"))
    return R.with_parents(top, parents)


@query(
    "A32_recall_report",
    """WITH g AS (SELECT o_custkey AS query_id, max(o_orderkey) AS id FROM orders GROUP BY 1), r AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5),
    n AS (SELECT o_orderkey AS id, o_orderkey % 3 AS parent, o_orderpriority AS l1 FROM orders), w AS (SELECT g.query_id, n.* FROM g JOIN n USING (id)),
    x AS (SELECT w.query_id, l1, rank, EXISTS (SELECT 1 FROM r JOIN n m USING (id) WHERE r.query_id = w.query_id AND m.parent = w.parent) AS near FROM w LEFT JOIN r ON r.query_id = w.query_id AND r.id = w.id)
    SELECT l1, count(*) AS queries, round(avg((rank IS NOT NULL)::INT), 8) AS strict, round(avg(near::INT), 8) AS lenient, round(avg(coalesce(1 / rank, 0)), 8) AS mrr FROM x GROUP BY ROLLUP (l1)""",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    gold = t.orders.groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_orderkey").alias("id"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), rank.alias("rank"))
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("parent"), F.col("o_orderpriority").alias("l1"))
    return R.recall_report(ranked, gold, nodes, 5).withColumns({c: F.round(c, 8) for c in ("strict", "lenient", "mrr")})
