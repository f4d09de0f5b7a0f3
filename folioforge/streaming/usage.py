"""Usage roll-ups: the same aggregates in batch and as a stream that merges late events into their hour."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.rollups import usage_rollup


def hourly(events: DataFrame) -> DataFrame:
    return usage_rollup(events, ["event_type"], "ts", "value")


def daily_unique(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("day", "ts").alias("slot"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def sampled(events: DataFrame, key: str, kind: str, rates: dict[str, float], other: float) -> DataFrame:
    """Events kept at their kind's rate, by a hash of their key: the same events each time."""
    rate = F.lit(other)
    for name, r in rates.items():
        rate = F.when(F.col(kind) == name, r).otherwise(rate)
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double")
    return events.filter(draw < rate * float(1 << 32))


def retained(events: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    return events.filter(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two roll-ups made one: counts, totals and slots add, the most is the greater."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.lit(0).cast("long"))
    added = F.reduce(F.collect_list("buckets"), slots, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return old.unionByName(new).groupBy("event_type", "slot").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.max("most").alias("most"), added.alias("buckets"))


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a roll-up that are whole: a write's mark of success is there."""
    store, place = _folder(spark, folder)
    if not store.exists(place):
        return []
    names = [f.getPath() for f in store.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if store.exists(_folder(spark, f"{p.toString()}/_SUCCESS")[1]))


def _store(batch: DataFrame, number: int, folder: str) -> None:
    """Merges a batch into the latest version; a batch that runs again writes the same version again, from the one before."""
    spark = batch.sparkSession
    new = hourly(batch)
    if number:
        new = merge(spark.read.parquet(f"{folder}/version={number - 1}"), new)
    new.write.mode("overwrite").parquet(f"{folder}/version={number}")
    for old in versions(spark, folder):
        if old < number - 1:  # the one before is kept for a batch that runs again
            store, path = _folder(spark, f"{folder}/version={old}")
            store.delete(path, True)


def stream_hourly(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Rolls a stream of events up into versioned Parquet: late events go to their own hour, at any time."""
    return events.writeStream.foreachBatch(partial(_store, folder=folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up as it stands: one version is read, whatever there were before."""
    return spark.read.parquet(f"{folder}/version={max(versions(spark, folder))}")


def windowed(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """A stream's hourly counts with a watermark: hours are given once, and state of past hours is dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def first_seen(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream's first event of each user and kind within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def _store_daily(batch: DataFrame, number: int, folder: str) -> None:
    """Adds a batch's events of each day, kind and user to the latest version; see _store."""
    spark = batch.sparkSession
    keys = ("slot", "event_type", "user_id")
    new = batch.groupBy(F.date_trunc("day", "ts").alias("slot"), "event_type", "user_id").agg(F.count("*").alias("n"))
    if number:
        new = spark.read.parquet(f"{folder}/version={number - 1}").unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))
    new.write.mode("overwrite").parquet(f"{folder}/version={number}")
    for old in versions(spark, folder):
        if old < number - 1:
            store, path = _folder(spark, f"{folder}/version={old}")
            store.delete(path, True)


def stream_daily(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Rolls a stream up by day, kind and user, so that a user who comes back on any later batch counts once a day."""
    return events.writeStream.foreachBatch(partial(_store_daily, folder=folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_latest(spark: SparkSession, folder: str) -> DataFrame:
    """slot, event_type, n, users as they stand."""
    return latest(spark, folder).groupBy("slot", "event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"))


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """A table of a folder, a file or a folder of files, as a stream of at most so many files a batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")


def pseudonym(column: str, secret: str) -> Column:
    """HMAC-SHA256 of the trimmed value as hex; null for a blank value or secret. The keyed hash is made of two plain ones."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    plain = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    keyed = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, plain.cast("binary")), 256))), 256)
    return F.when((plain != "") & F.lit(bool(secret)), keyed)
