"""Joins with semantics of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.names import own


def expand_taxonomy(nodes: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """The ids asked for and all below them, in a tree of fixed depth. nodes: id, parent."""
    found = level = asked.select("id")
    for _ in range(depth - 1):
        level = nodes.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        found = found.unionByName(level)
    return found.distinct()


def parent_chain(leaves: DataFrame, middle: DataFrame, top: DataFrame) -> DataFrame:
    """Each leaf with its two ancestors; orphans drop out. Tables: id, label, parent_id."""
    m = middle.select(F.col("id").alias("parent_id"), F.col("label").alias("middle_label"), F.col("parent_id").alias("_top"))
    u = top.select(F.col("id").alias("_top"), F.col("label").alias("top_label"))
    return leaves.join(m, "parent_id").join(u, "_top").select("id", "label", "middle_label", "top_label")


def label_of(rows: DataFrame, code: str, *lookups: DataFrame) -> DataFrame:
    """`label` of a code: the last lookup that knows it wins; a code no one knows stands for itself. lookups: code, label, each code once."""
    names = []
    for k, lookup in enumerate(lookups):
        names.append(f"_label{k}")
        rows = rows.join(lookup.select(F.col("code").alias(code), F.col("label").alias(names[-1])), code, "left")
    return rows.withColumn("label", F.coalesce(*reversed(names), F.col(code).cast("string"))).drop(*names)


def with_flags(rows: DataFrame, flagged: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """An update join: rows whose key is flagged get 1, the others keep what they have, or 0."""
    (mark,) = own(rows, "_flag")
    marks = flagged.select(*keys).distinct().withColumn(mark, F.lit(1))
    now = F.col(flag) if flag in rows.columns else F.lit(0)
    return rows.join(marks, list(keys), "left").withColumn(flag, F.coalesce(mark, now, F.lit(0))).drop(mark)


def counts_or_zero(totals: DataFrame, hits: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    return totals.join(hits, list(keys), "left").withColumn(count, F.coalesce(count, F.lit(0)))


def fill_from_losers(rows: DataFrame, survivors: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Survivors take from the rows they replace what they lack: the value of the loser with the least key. survivors: loser, survivor."""
    had = rows.join(survivors.withColumnRenamed("loser", key), key)
    best = had.groupBy("survivor").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_{c}") for c in columns])
    kept = rows.join(survivors.select(F.col("loser").alias(key)), key, "left_anti").join(best.withColumnRenamed("survivor", key), key, "left")
    return kept.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def versioned_id(request: Column) -> tuple[Column, Column]:
    """The parts of an id of the form page::version; a version that is no number is null."""
    return F.substring_index(request, "::", 1), F.substring_index(request, "::", -1).try_cast("int")


def crosswalked(rows: DataFrame, code: str, walk: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with sic and class: of the walk's prefixes (prefix, sic) of the code the longest gives the sic, and of the classes'
    prefixes of that (prefix, class) the longest gives the class; null where none fits. Both tables are small code lists."""

    def longest(left: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
        codes = left.select(F.col(key).cast("string").alias("_code")).filter("_code IS NOT NULL").distinct()
        starts = codes.select("_code", F.explode(F.transform(F.sequence(F.lit(0), F.length("_code")), lambda n: F.substring(F.col("_code"), F.lit(1), n))).alias("_start"))
        named = table.select(F.col("prefix").cast("string").alias("_start"), F.col(value).alias("_value"))
        # of several values of one prefix the greatest
        best = starts.join(named, "_start").groupBy("_code").agg(F.max(F.struct(F.length("_start").alias("n"), F.col("_value").alias("v"))).alias("_best"))
        return left.join(best, F.col(key).cast("string") == F.col("_code"), "left").withColumn(value, F.col("_best.v")).drop("_code", "_best")

    return longest(longest(rows, code, walk, "sic"), "sic", classes, "class")
