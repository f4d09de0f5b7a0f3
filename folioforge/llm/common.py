"""What the operators of this subpackage share: shared folders, ASCII folding, lookups that survive hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot when it holds more than one row in HOT_SHARE; so at most HOT_SHARE keys are hot, which bounds what is broadcast.
HOT_SHARE = 1000
#: Short rows (a few integers) for which a task of its own is worth while.
FULL = 1 << 12


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder the cluster names in spark.checkpoint.dir; a local one only where none is named and
    Spark runs on this machine alone."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        context.setCheckpointDir(root)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fitted(frame: DataFrame, rows: int) -> DataFrame:
    """A frame of so many short rows at most in as many tasks as they fill: with hundreds of shuffle partitions nearly all would be
    empty, and each writes files and events of its own. A larger frame keeps its partitions."""
    return frame.coalesce(max(1, -(-rows // FULL)))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives its free memory back to the system at its end: workers live on, and later stages need theirs on top."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def strings(column: pa.Array) -> Iterator[str | None]:
    """A column's texts, one at a time: a batch of long texts is not held twice."""
    return (x.as_py() for x in column)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All of a table's columns as one, `row`: beside it an operator's own columns clash with none of them. select("row.*") unpacks."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("row")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. A text with as many bytes as characters is plain ASCII, where lower() does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(rows: DataFrame, names: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with names, which has each of keys once and in `count` how many of the `total` rows carry it.

    Keys with over total / HOT_SHARE rows, fewer than HOT_SHARE of them, are broadcast, so no task gets a hot key's rows;
    each other key has at most total / HOT_SHARE rows and goes through a shuffle. Keys must not be null.
    """
    least = max(1, total // HOT_SHARE)
    hot = F.broadcast(names.filter(F.col(count) > least).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in names.columns if c not in keys], "_hot"), keys, "left")
    rest = [c for c in names.columns if c not in keys]
    warm = marked.filter(F.col("_hot")).select(*rows.columns, *[F.col(f"_b_{c}").alias(c) for c in rest])
    # asking for every column, though _hot says it all, keeps the plan of `names` the same in both parts, so that it is run once
    cold = marked.filter(reduce(lambda a, b: a & b, [F.col(f"_b_{c}").isNull() for c in rest], F.col("_hot").isNull())).select(*rows.columns)
    return warm.unionByName(cold.join(names.filter(F.col(count) <= least), keys).select(*rows.columns, *rest))
