"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import search, states
from folioforge.plans.registry import Tables, query
from folioforge.sources import readers, sinks
from folioforge.streaming import usage


@query("S1_checked_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000")
def _(t: Tables) -> DataFrame:
    rows = readers.read_table(t.spark, f"{t.folder}/orders.parquet")
    return readers.require(rows, {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"}).filter("o_totalprice > 1000").select("o_orderkey", "o_orderstatus", "o_totalprice")


_INDEX = """'<table><tr><th>Type</th><th>Document</th></tr>' || '<tr><td>10-K</td><td><a href="/main' || page_id || '.htm">x</a></td></tr><tr><td> EX-' || CASE page_id % 4 WHEN 0 THEN '2.1' WHEN 1 THEN '10' WHEN 2 THEN '99.1' ELSE '2' END || ' </td><td><a class="l" href="' || CASE WHEN page_id % 3 = 0 THEN 'https://other/' ELSE '/d/' END || page_id || '.htm">y</a></td></tr></table>'"""


@query("S5_exhibit_links", "SELECT CASE WHEN page_id % 3 = 0 THEN 'https://other/' ELSE 'https://host/d/' END || page_id || '.htm' AS url FROM pages WHERE page_id % 4 <> 2")
def _(t: Tables) -> DataFrame:
    return readers.index_links(t.pages.select(F.expr(_INDEX).alias("html")), "https://host")


@query(
    "S6_rendered",
    r"""SELECT page_id, kind, CASE kind WHEN 'txt' THEN html END AS text FROM (SELECT page_id, html, CASE WHEN ends_with(u, '.txt') THEN 'txt' WHEN regexp_matches(u, '\.html?$') THEN 'html' END AS kind
    FROM (SELECT *, lower(regexp_replace(url || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.TXT' WHEN 2 THEN '.htm?x=1' ELSE '.html#a' END, '[?#].*$', '')) AS u FROM pages))""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(k == 0, "").when(k == 1, ".TXT").when(k == 2, ".htm?x=1").otherwise(".html#a"))
    out = readers.rendered(t.pages.withColumn("url", url), "page_id", "url", "html")
    return out.withColumn("text", F.when(F.col("kind") == "txt", F.col("text")))


@query("S7_json_lines", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 9 = 0 AS corrupt FROM events")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch_dir(t.spark, "jsonl")
    line = F.when(F.col("event_id") % 9 > 0, F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")))).otherwise(F.concat(F.lit('{"event_id": '), "event_id", F.lit(", broken")))
    sinks.write_lines(t.events.select(line.alias("value")), folder)
    rows = readers.read_json_lines(t.spark, folder, "event_id long, k long")
    lost = F.regexp_extract("_corrupt", '"event_id": ?([0-9]+)', 1).try_cast("long")
    return rows.select(F.coalesce("event_id", lost).alias("event_id"), "k", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("S9_training_scan", "SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY quality, doc_id) AS place FROM labels")
def _(t: Tables) -> DataFrame:
    return readers.read_training(t.spark, f"{t.folder}/labels.parquet", {"doc_id": "bigint", "quality": "int", "toxic": "int"}, "quality", ["quality", "doc_id"])


@query("S10_appended_rows", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM orders")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch_dir(t.spark, "csv")
    for part, run in ((0, "first"), (1, "second")):
        sinks.append_csv(t.orders.filter(F.col("o_orderkey") % 2 == part).select("o_orderkey", "o_totalprice", F.lit(run).alias("run")), folder)
    return t.spark.read.schema("o_orderkey long, o_totalprice double, run string").option("header", True).csv(folder)


@query("S12_last_wins", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'LAST' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 10000001, 'NEW'")
def _(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_mktsegment")
    some = old.filter("c_custkey % 4 = 0").select("c_custkey")
    new = some.select("c_custkey", F.lit("MIDDLE").alias("c_mktsegment"), F.lit(1).alias("at")).unionByName(some.select("c_custkey", F.lit("LAST").alias("c_mktsegment"), F.lit(2).alias("at")))
    new = new.unionByName(t.spark.createDataFrame([(10_000_001, "NEW", 1)], "c_custkey long, c_mktsegment string, at int"))
    return sinks.last_wins(old, new, ["c_custkey"], "at")


@query("S16_rebuilt_summary", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch_dir(t.spark, "summary")
    for rows in (t.orders.limit(10), t.orders):
        sinks.rebuild(t.spark, folder, lambda rows=rows: rows.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return t.spark.read.parquet(folder)


@query("S17_dump_and_restore", "SELECT 'nation' AS tbl, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(t: Tables) -> DataFrame:
    folder = sinks.scratch_dir(t.spark, "dump")
    sinks.dump(t.spark, {"nation": t.nation, "region": t.region, "customer": t.customer}, ["nation", "region"], folder)
    back = sinks.restore(t.spark, folder)
    parts = [rows.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")) for name, rows in sorted(back.items())]
    return parts[0].unionByName(parts[1])


@query("S19_paged_download", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey <= 500")
def _(t: Tables) -> DataFrame:
    held = [(r.o_orderkey, r.o_orderstatus) for r in t.orders.filter("o_orderkey <= 500").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").collect()]

    def fetch(cursor: str | None) -> tuple[list[tuple], str | None]:
        at = int(cursor or 0)
        return held[at : at + 100], str(at + 100) if at + 100 < len(held) else None

    return readers.download_pages(t.spark, fetch, "id long, status string", sinks.scratch_dir(t.spark, "pages"))


@query("F24_page_sizes", "SELECT o_orderkey, CASE WHEN o_custkey % 130 - 5 > 0 THEN least(o_custkey % 130 - 5, CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 10 END) ELSE least(25, CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 10 END) END AS size FROM orders")
def _(t: Tables) -> DataFrame:
    from folioforge.functions.predicates import clamped_size

    most = F.when(F.col("o_orderkey") % 2 == 0, 100).otherwise(10)
    return t.orders.select("o_orderkey", clamped_size(F.col("o_custkey") % 130 - 5, most).alias("size"))


@query("L8_count_memo", "SELECT o_orderstatus AS status, count(*) AS n, 1 AS counted FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    memo, counted, rows = search.CountMemo(), {}, []
    for status in ("F", "O", "P"):
        for filters in ({"table": "orders", "status": status}, {"status": status, "table": "orders"}):

            def count(status=status) -> int:
                counted[status] = counted.get(status, 0) + 1
                return t.orders.filter(F.col("o_orderstatus") == status).count()

            n = memo.count(filters, count)
        rows.append((status, n, counted[status]))
    return t.spark.createDataFrame(rows, "status string, n long, counted int")


def _padded(secret: str, pad: int) -> str:
    """A blob of SQL: the key of 64 bytes with each byte turned."""
    return "'" + "".join(f"\\x{x ^ pad:02X}" for x in secret.encode().ljust(64, b"\0")) + "'::BLOB"


@query("T29_pseudonyms", f"SELECT event_id, sha256({_padded('secret', 0x5C)} || unhex(sha256({_padded('secret', 0x36)} || encode('10.0.' || user_id % 256 || '.' || event_id % 7)))) AS pseudonym FROM events")
def _(t: Tables) -> DataFrame:
    said = t.events.select("event_id", F.concat(F.lit(" 10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 7, F.lit(" ")).alias("ip"))
    return said.select("event_id", usage.pseudonym("ip", "secret").alias("pseudonym"))


@query("G5_resumed_run", "SELECT * FROM (VALUES ('a', 'done', 1), ('b', 'done', 1), ('c', 'done', 1)) x(stage, state, runs)")
def _(t: Tables) -> DataFrame:
    ledger, ran = states.Ledger(t.spark, sinks.scratch_dir(t.spark, "ledger")), {}

    def work(name: str, fails: bool) -> None:
        if fails:
            raise RuntimeError("stopped")
        ran[name] = ran.get(name, 0) + 1

    for stops in (True, False):
        try:
            ledger.resume("run", {"a": lambda: work("a", False), "b": lambda s=stops: work("b", s), "c": lambda: work("c", False)})
        except RuntimeError:
            continue
    rows = ledger.rows().filter("run = 'run'").groupBy("stage").agg(F.max_by("state", "at").alias("state"))
    return rows.join(t.spark.createDataFrame(sorted(ran.items()), "stage string, runs int"), "stage").select("stage", "state", "runs")
