"""Firm names: fields of several firms split with a table of known joint names, and names brought to one key with tables of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import counsel_key, firm_display, split_firms


def split_names(rows: DataFrame, field: str, joint: DataFrame) -> DataFrame:
    """rows with `firm`, one for each firm of the field, in order (place). joint: display or key of a joint name, and its firms (array).

    Aliases are lists of some hundred names; Spark broadcasts them while they are below its limit, and shuffles them beyond."""
    named = rows.select("*", F.posexplode(split_firms(F.col(field))).alias("_at", "_firm"))
    named = named.withColumns({"_display": firm_display(F.col("_firm")), "_key": counsel_key(firm_display(F.col("_firm")))})
    exact = joint.select(F.col("name").alias("_display"), F.col("firms").alias("_exact"))
    keyed = joint.groupBy(counsel_key(F.col("name")).alias("_key")).agg(F.min("firms").alias("_keyed"))
    found = named.join(exact, "_display", "left").join(keyed, "_key", "left")
    firms = F.coalesce("_exact", "_keyed", F.array("_firm"))
    return found.select(*rows.columns, "_at", F.posexplode(firms).alias("_in", "firm")).withColumn("place", F.struct("_at", "_in")).drop("_at", "_in")


def canonical_names(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with `firm_key`: of the name an alias stands for (by its name as shown, else by its key), else of the name itself; null if
    nothing is left of it. aliases: name, instead; of several for one key the least counts."""
    shown = rows.withColumn("_display", firm_display(F.col(name)))
    shown = shown.withColumn("_key", counsel_key(F.col("_display")))
    exact = aliases.groupBy(F.col("name").alias("_display")).agg(F.min("instead").alias("_exact"))
    keyed = aliases.groupBy(counsel_key(F.col("name")).alias("_key")).agg(F.min("instead").alias("_keyed"))
    found = shown.join(exact, "_display", "left").join(keyed, "_key", "left")
    key = counsel_key(F.coalesce("_exact", "_keyed", "_display"))
    return found.withColumn("firm_key", F.when(F.col("_display") != "", F.nullif(key, F.lit("")))).select(*rows.columns, "firm_key")
