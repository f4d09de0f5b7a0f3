"""Sinks: upserts, merges and replacements as new versions of a table, and dumps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.sequence import keep_last


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The table after the last new row of each key, with change: inserted, updated (a value differs, nulls alike) or kept."""
    values = [c for c in old.columns if c not in keys]
    last = keep_last(new, keys, arrival).select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(last, list(keys), "full")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in values], F.lit(False))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNotNull() & differs, "updated").otherwise("kept")
    return joined.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values], change.alias("change"))


def merged_keeping(old: DataFrame, new: DataFrame, keys: Sequence[str], once: Sequence[str] = ()) -> DataFrame:
    """The table after new values, each key once in new; a null keeps what was there, and a column of `once` is set only where it was null."""
    values = [c for c in old.columns if c not in keys]
    joined = old.join(new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values]), list(keys), "full")
    return joined.select(*keys, *[(F.coalesce(c, f"_n_{c}") if c in once else F.coalesce(f"_n_{c}", c)).alias(c) for c in values])


def replaced(old: DataFrame, scope: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with all rows of the scope's keys taken out and the new rows put in."""
    return old.join(scope.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose key is among those gone."""
    column = gone.columns[0]
    return {name: rows.join(gone.select(F.col(column).alias(keys[name])).distinct(), keys[name], "left_anti") for name, rows in tables.items()}


def overwrite(frame: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Writes a table anew; with partition columns, only the partitions that the frame has."""
    writer = frame.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def dump(spark: SparkSession, tables: dict[str, DataFrame], allowed: Sequence[str], folder: str) -> DataFrame:
    """Writes the allowed tables, and a manifest: table, rows, columns."""
    rows = []
    for name in allowed:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((name, spark.read.parquet(f"{folder}/{name}").count(), ",".join(tables[name].columns)))
    manifest = spark.createDataFrame(rows, "table string, rows long, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A dump's tables; ValueError if one does not have the rows its manifest names."""
    out = {}
    for r in spark.read.schema("table string, rows long, columns string").json(f"{folder}/manifest").collect():
        out[r.table] = spark.read.parquet(f"{folder}/{r.table}")
        if out[r.table].count() != r.rows:
            raise ValueError(f"{r.table} is not whole")
    return out


def append_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").option("header", True).csv(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the folder that spark.checkpoint.dir names; a local one only where none is named, on a local master."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows of one text column as the lines of files."""
    rows.write.mode("append").text(path)


def last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The table after each key's last new row, whole, has taken the place of what was there."""
    last = keep_last(new, keys, arrival).select(*old.columns)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def rebuild(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> None:
    """Makes a table anew, one writer at a time: a lock file beside it is created, which fails if another holds it, and taken away at the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    lock = hadoop.Path(path + ".lock")
    store = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.createNewFile(lock):
        raise RuntimeError(f"{path} is being rebuilt")
    try:
        make().write.mode("overwrite").parquet(path)
    finally:
        store.delete(lock, False)
