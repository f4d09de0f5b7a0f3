"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, fitted, lookup


def star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One star step over edges (u, v) with u > v, of which there are `most` at most.

    Large: each node links its larger neighbours to its least neighbour. Small: each node links its smaller neighbours, and
    itself, to the least of them. A node's least neighbour comes from a combined aggregate and goes back through a lookup, so a
    node with very many neighbours does not meet in one task. Each step has tasks for as many rows as it has, not more.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    rows = 2 * most if large else most
    least = fitted(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), rows).withColumn("m", F.least("m", "u"))
    linked = fitted(lookup(both, least, ["u"], "_n", rows), rows)
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return fitted(out.filter(F.col("u") > F.col("v")).distinct(), rows)


def state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (u, v) there are, and whether they still have to be worked on: in stars each u has one v, which is nobody's u."""
    ends = edges.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(int(c == "u")).alias("up")) for c in "uv"])).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("least") == 0)), F.lit(False))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge: root is the least node of its component. edges: u, v (long), not null."""
    ordered = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(ordered)
    count, more = state(now)
    now = fitted(now, count)
    while more:
        wide = cut(star(now, True, count))  # not more edges than before
        now = cut(star(wide, False, count))
        count, more = state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(fitted(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), count))
