"""State of documents in the pipeline: stages, queues, gates, validation, batch keys, and a run ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage() -> Column:
    """The stage that a document is in, by its components (see QUEUES): the first whose work is not done."""
    c = F.col
    done = (c("latest_section_count") > 0) & (c("has_stale_body_tags") == 0)
    return (
        F.when(c("is_not_paginated") == 1, "1_pre_processing").when(c("page_count") == 0, "0_staging")
        .when((c("body_page_count") == 0) | (c("tagged_body_page_count") < c("body_page_count")), "1_pre_processing")
        .when(c("has_latest_xml") == 0, "2_tagging").when((c("latest_xml_status") == "verified") & done, "processed").otherwise("3_xml")
    )


def colour() -> Column:
    """green: processed; yellow: can go on; red: held up by a gate, by having no body, or by its XML; gray: is not paginated."""
    c = F.col
    done = (c("latest_section_count") > 0) & (c("has_stale_body_tags") == 0)
    gated = lambda gate: F.when(c(gate) == 1, "red").otherwise("yellow")
    return (
        F.when(c("is_not_paginated") == 1, "gray").when(c("page_count") == 0, gated("agreement_is_gated")).when(c("body_page_count") == 0, "red")
        .when(c("tagged_body_page_count") < c("body_page_count"), gated("page_is_gated")).when(c("has_latest_xml") == 0, "yellow")
        .when(c("latest_xml_status") == "verified", F.when(done, "green").otherwise("yellow")).otherwise("red")
    )


#: Articles that a document's XML has at least, less one, before its repair is asked for.
FEW_ARTICLES = 5


def queues() -> dict[str, Column]:
    """The eight queues of work, each as a condition on a document's components.

    Components: is_not_paginated, page_count, body_page_count, tagged_body_page_count, agreement_is_gated, page_is_gated,
    has_latest_xml, latest_xml_status (null: not looked at yet), latest_xml_ai_repair_attempted, latest_section_count,
    has_stale_body_tags; for repairs also article_count and repairable (a reason of the wanted kind with a page)."""
    c = F.col
    xml, status, tried, stale = c("has_latest_xml") == 1, c("latest_xml_status"), c("latest_xml_ai_repair_attempted") == 1, c("has_stale_body_tags") == 1
    tagged = (c("body_page_count") > 0) & (c("tagged_body_page_count") == c("body_page_count"))
    verified, invalid = F.coalesce(status == "verified", F.lit(False)), F.coalesce(status == "invalid", F.lit(False))
    unsectioned = verified & (c("latest_section_count") == 0)
    return {
        "pre_processing": (c("is_not_paginated") == 0) & (c("page_count") == 0) & (c("agreement_is_gated") == 0),
        "tagging": (c("is_not_paginated") == 0) & (c("page_count") > 0) & (c("body_page_count") > 0) & (c("tagged_body_page_count") < c("body_page_count")) & (c("page_is_gated") == 0),
        "xml_build": tagged & (~xml | stale | unsectioned | (status.isNull() & ~tried)),
        "xml_verify": xml & status.isNull() & ~tried,
        "sections": xml & unsectioned & ~stale,
        "post_repair_build": xml & invalid & tried & tagged & stale,
        "post_repair_verify": xml & status.isNull() & tried,
        "repair": xml & invalid & ~stale & (c("article_count") > FEW_ARTICLES) & c("repairable"),
    }


def work_queues(states: DataFrame, key: str) -> DataFrame:
    """queue and key of every document that waits in a queue; one pass over the components."""
    names = F.array_compact(F.array(*[F.when(condition, name) for name, condition in queues().items()]))
    return states.select(F.explode(names).alias("queue"), key)


def gates(pages: DataFrame, key: str, flagged: Column) -> DataFrame:
    """key, gated: one flagged page gates its whole document."""
    return pages.groupBy(key).agg(F.max(F.when(flagged, 1).otherwise(0)).alias("gated"))


def batch_key(ids: Column) -> Column:
    """The same for the same set of ids, in whatever order."""
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"))


def batch_keys(rows: DataFrame, scope: str, key: str, size: int = 1000) -> DataFrame:
    """scope, batch, key: the key of each batch, the ids of one range of `size` numbers, so that none grows with the table."""
    batch = F.floor(F.col(key) / size).cast("long").alias("batch")
    return rows.groupBy(scope, batch).agg(batch_key(F.collect_list(F.col(key).cast("string"))).alias("key"))


def price_total(kind: Column, cash: Column, stock: Column, assets: Column) -> Column:
    """cash gives cash, stock gives stock; any other kind, none included, needs two parts at least and sums them."""
    parts = F.array_compact(F.array(cash, stock, assets))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(kind == "cash", cash).when(kind == "stock", stock).when(F.size(parts) >= 2, total)


def price_conflict(kind: Column, cash: Column, stock: Column, assets: Column) -> Column:
    """A price all in cash, or all in stock, that has something of another part."""
    some = lambda c: F.coalesce(c, F.lit(0.0)) > 0
    return F.coalesce(((kind == "cash") & (some(stock) | some(assets))) | ((kind == "stock") & (some(cash) | some(assets))), F.lit(False))


def violations(rules: dict[str, Column]) -> Column:
    """The codes of the rules that a row breaks; a rule that is null is not broken."""
    return F.array_compact(F.array(*[F.when(broken, code) for code, broken in rules.items()]))


class Ledger:
    """Runs and their stages as rows of a Parquet table: a stage that is done is not done again."""

    SCHEMA = "run string, stage string, state string, at timestamp"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def record(self, run: str, stage_name: str, state: str) -> None:
        self.spark.createDataFrame([(run, stage_name, state)], "run string, stage string, state string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as error:  # no run yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def done(self, run: str) -> set[str]:
        last = self.rows().filter(F.col("run") == run).groupBy("stage").agg(F.max_by("state", "at").alias("state"))
        return {r.stage for r in last.filter("state = 'done'").collect()}

    def resume(self, run: str, stages: dict) -> list[str]:
        """Runs the stages not yet done, in order; the names of those run."""
        made, done = [], self.done(run)
        for name, work in stages.items():
            if name not in done:
                self.record(run, name, "started")
                work()
                self.record(run, name, "done")
                made.append(name)
        return made
