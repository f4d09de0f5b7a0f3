"""State derivation, gates, streaming roll-ups in batch, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import states as S
from folioforge.plans.registry import Tables, query
from folioforge.sources import sinks
from folioforge.streaming import usage

_STATES = """
SELECT o_orderkey, (o_orderkey % 17 = 0)::INT AS is_not_paginated, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE n END AS page_count, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE body END AS body_page_count, CASE WHEN o_orderkey % 19 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN tagged ELSE body END AS tagged_body_page_count,
  (o_orderpriority = '1-URGENT')::INT AS agreement_is_gated, risky AS page_is_gated, (o_orderkey % 5 > 0)::INT AS has_latest_xml, CASE WHEN o_orderkey % 5 > 0 THEN [NULL, 'invalid', 'invalid', 'verified', 'verified', 'verified', 'other'][o_orderkey % 7 + 1] END AS latest_xml_status,
  (o_orderkey % 4 = 0)::INT AS latest_xml_ai_repair_attempted, o_custkey % 3 AS latest_section_count, (o_orderkey % 11 = 0)::INT AS has_stale_body_tags, n + o_custkey % 5 AS article_count, o_custkey % 2 = 0 AS repairable
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber > 1) AS body, count(*) FILTER (WHERE l_linenumber > 1 AND l_discount > 0.03) AS tagged, max((l_tax > 0.06)::INT) AS risky FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


def components(t: Tables) -> DataFrame:
    """Orders as documents, their lines as pages, and an XML for some, made of their keys."""
    c, number = F.col, lambda x: x.cast("int")
    body = F.col("l_linenumber") > 1
    pages = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(body).alias("body"), F.count_if(body & (c("l_discount") > 0.03)).alias("tagged"), F.max(number(c("l_tax") > 0.06)).alias("risky"))
    k, none = c("o_orderkey"), c("o_orderkey") % 19 == 0
    kinds = F.array(F.lit(None).cast("string"), *[F.lit(x) for x in ("invalid", "invalid", "verified", "verified", "verified", "other")])
    made = {
        "is_not_paginated": number(k % 17 == 0), "page_count": F.when(none, 0).otherwise(c("n")), "body_page_count": F.when(none, 0).otherwise(c("body")), "tagged_body_page_count": F.when(none, 0).when(k % 3 == 0, c("tagged")).otherwise(c("body")),
        "agreement_is_gated": number(c("o_orderpriority") == "1-URGENT"), "page_is_gated": c("risky"), "has_latest_xml": number(k % 5 > 0), "latest_xml_status": F.when(k % 5 > 0, F.element_at(kinds, (k % 7 + 1).cast("int"))),
        "latest_xml_ai_repair_attempted": number(k % 4 == 0), "latest_section_count": c("o_custkey") % 3, "has_stale_body_tags": number(k % 11 == 0), "article_count": c("n") + c("o_custkey") % 5, "repairable": c("o_custkey") % 2 == 0,
    }
    return t.orders.join(pages, c("l_orderkey") == k).select("o_orderkey", *[v.alias(name) for name, v in made.items()])


@query(
    "G1_stage_and_colour",
    f"""SELECT o_orderkey, CASE WHEN is_not_paginated = 1 THEN '1_pre_processing' WHEN page_count = 0 THEN '0_staging' WHEN body_page_count = 0 OR tagged_body_page_count < body_page_count THEN '1_pre_processing' WHEN has_latest_xml = 0 THEN '2_tagging'
    WHEN latest_xml_status IS NULL THEN '3_xml' WHEN latest_xml_status = 'invalid' THEN '3_xml' WHEN latest_xml_status = 'verified' AND (latest_section_count = 0 OR has_stale_body_tags = 1) THEN '3_xml' WHEN latest_xml_status = 'verified' THEN 'processed' ELSE '3_xml' END AS stage,
    CASE WHEN is_not_paginated = 1 THEN 'gray' WHEN page_count = 0 THEN CASE WHEN agreement_is_gated = 1 THEN 'red' ELSE 'yellow' END WHEN body_page_count = 0 THEN 'red' WHEN tagged_body_page_count < body_page_count THEN CASE WHEN page_is_gated = 1 THEN 'red' ELSE 'yellow' END
    WHEN has_latest_xml = 0 THEN 'yellow' WHEN latest_xml_status IS NULL OR latest_xml_status = 'invalid' THEN 'red' WHEN latest_xml_status = 'verified' AND (latest_section_count = 0 OR has_stale_body_tags = 1) THEN 'yellow' WHEN latest_xml_status = 'verified' THEN 'green' ELSE 'red' END AS colour FROM ({_STATES})""",
)
def _(t: Tables) -> DataFrame:
    return components(t).select("o_orderkey", S.stage().alias("stage"), S.colour().alias("colour"))


_QUEUES = {
    "pre_processing": "is_not_paginated = 0 AND page_count = 0 AND agreement_is_gated = 0",
    "tagging": "is_not_paginated = 0 AND page_count > 0 AND body_page_count > 0 AND body_page_count - tagged_body_page_count > 0 AND page_is_gated = 0",
    "xml_build": "body_page_count > 0 AND tagged_body_page_count = body_page_count AND (has_latest_xml = 0 OR has_stale_body_tags = 1 OR (latest_xml_status = 'verified' AND latest_section_count = 0) OR (latest_xml_status IS NULL AND latest_xml_ai_repair_attempted = 0))",
    "xml_verify": "has_latest_xml = 1 AND latest_xml_status IS NULL AND latest_xml_ai_repair_attempted = 0",
    "sections": "has_latest_xml = 1 AND latest_xml_status = 'verified' AND latest_section_count = 0 AND has_stale_body_tags = 0",
    "post_repair_build": "has_latest_xml = 1 AND latest_xml_status = 'invalid' AND latest_xml_ai_repair_attempted = 1 AND body_page_count > 0 AND tagged_body_page_count = body_page_count AND has_stale_body_tags = 1",
    "post_repair_verify": "has_latest_xml = 1 AND latest_xml_status IS NULL AND latest_xml_ai_repair_attempted = 1",
    "repair": "latest_xml_status = 'invalid' AND has_stale_body_tags = 0 AND article_count > 5 AND repairable",
}


@query("G2_work_queue", f"WITH s AS ({_STATES}) " + " UNION ALL ".join(f"SELECT '{name}' AS queue, o_orderkey FROM s WHERE {condition}" for name, condition in _QUEUES.items()))
def _(t: Tables) -> DataFrame:
    return S.work_queues(components(t), "o_orderkey")


@query("G3_gates", "SELECT l_orderkey, max((l_discount > 0.08)::INT) AS gated FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.gates(t.lineitem, "l_orderkey", F.col("l_discount") > 0.08)


@query("G4_priority", "SELECT l_orderkey, l_linenumber, l_partkey, round(1 - l_discount, 8) AS priority FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(1 - F.col("l_discount"), 8).alias("priority"))


@query("G6_batch_keys", "SELECT source, doc_id // 1000 AS batch, sha1(array_to_string(list_sort(list(doc_id::VARCHAR)), chr(10))) AS key FROM documents GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return S.batch_keys(t.documents, "source", "doc_id")


@query("ST1_hourly_rollup", "SELECT event_type, date_trunc('hour', ts) AS slot, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total, max(value) AS most FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return usage.hourly(t.events).select("event_type", "slot", "n", "total", "most")


@query("ST2_daily_unique", "SELECT date_trunc('day', ts)::TIMESTAMP AS slot, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return usage.daily_unique(t.events)


@query("ST1_hourly_stream", "SELECT event_type, date_trunc('hour', ts) AS slot, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total, max(value) AS most FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """The same roll-up by a stream of the table's files."""
    folder = sinks.scratch_dir(t.spark, "hourly")
    usage.stream_hourly(usage.table_stream(t.spark, t.folder, "events"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return usage.latest(t.spark, f"{folder}/out").select("event_type", "slot", "n", "total", "most")


@query("ST2_daily_stream", "SELECT date_trunc('day', ts)::TIMESTAMP AS slot, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch_dir(t.spark, "daily")
    usage.stream_daily(usage.table_stream(t.spark, t.folder, "events"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return usage.daily_latest(t.spark, f"{folder}/out")


@query("ST3_sampling", "SELECT event_id FROM events WHERE event_type = 'error' OR ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT < CASE WHEN event_type = 'purchase' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END * 4294967296")
def _(t: Tables) -> DataFrame:
    return usage.sampled(t.events, "event_id", "event_type", {"error": 1.0, "purchase": 0.5}, 0.1).select("event_id")


@query("ST4_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def _(t: Tables) -> DataFrame:
    latest = t.events.agg(F.max("ts").alias("latest"))
    return usage.retained(t.events.crossJoin(F.broadcast(latest)), "ts", F.col("latest"), 10).select("event_id")


@query("S2_index_lines", "SELECT 'EX-2' AS form, c_name || ' & Co' AS company, c_custkey::VARCHAR AS cik, '2020-01-02' AS filed, 'edgar/data/' || c_custkey || '.txt' AS file FROM customer WHERE c_custkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    from folioforge.sources.readers import parse_index

    form = F.when(F.col("c_custkey") % 2 == 0, "EX-2").otherwise("10-K")
    lines = t.customer.select(F.concat_ws("   ", form, F.concat(F.col("c_name"), F.lit(" & Co")), F.col("c_custkey"), F.lit("2020-01-02"), F.concat(F.lit("edgar/data/"), "c_custkey", F.lit(".txt"))).alias("value"))
    return parse_index(lines, ["EX-2", "EX-10"])


@query("S3_daily_urls", "SELECT d::DATE AS day, 'https://host/' || year(d) || '/QTR' || quarter(d) || '/form.' || strftime(d, '%Y%m%d') || '.idx' AS url FROM range(TIMESTAMP '2020-03-30', TIMESTAMP '2020-04-03', INTERVAL 1 DAY) r(d)")
def _(t: Tables) -> DataFrame:
    from folioforge.sources.readers import daily_urls

    return daily_urls(t.spark, "https://host", "2020-03-29", 4)


@query("S8_verified_manifest", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents")
def _(t: Tables) -> DataFrame:
    from folioforge.sources.readers import manifest_states

    manifest = t.documents.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "other").otherwise(F.sha2("text", 256)).alias("sha256"))
    return manifest_states(t.documents, manifest, "doc_id", "text")


@query(
    "S11_changed_upsert",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'NEW' THEN 'updated' ELSE 'kept' END AS change FROM customer UNION ALL SELECT 10000000, 'ADDED', 'inserted'",
)
def _(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_mktsegment")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(2).alias("at")).unionByName(old.filter("c_custkey % 3 = 0").withColumn("at", F.lit(1)))
    new = new.unionByName(t.spark.createDataFrame([(10_000_000, "ADDED", 1)], "c_custkey long, c_mktsegment string, at int"))
    return sinks.upserted(old, new, ["c_custkey"], "at")


@query("S13_preserving_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_mktsegment")
    new = old.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"))
    return sinks.merged_keeping(old, new, ["c_custkey"])


@query("S14_replaced_scope", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 1, 0, 7.0 FROM orders WHERE o_orderkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    old = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    scope = t.lineitem.filter("l_orderkey % 2 = 0").select("l_orderkey").distinct()
    new = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), F.lit(7.0).alias("l_quantity"))
    return sinks.replaced(old, scope, new, ["l_orderkey"])


@query("S15_cascading_delete", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0")
def _(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.cascaded({"orders": t.orders}, gone, {"orders": "o_custkey"})["orders"].select("o_orderkey")


@query("S18_signature_store", "SELECT doc_id, 32 AS n FROM documents")
def _(t: Tables) -> DataFrame:
    stored = t.documents.select("doc_id", F.to_json(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda p: F.xxhash64("text", p))).alias("minhash"))
    return stored.select("doc_id", F.size(F.from_json("minhash", "array<bigint>")).alias("n"))
