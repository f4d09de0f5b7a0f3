"""Splits that keep the shares of labels: by many labels a row, rarest first, and by strata that back off where they are small."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct sets of labels at most; they, not the rows, come to the driver.
MOST_SETS = 100_000
#: Slots of the hash by which rows of one set are ordered, so that a set of very many rows is ordered in parts.
SLOTS = 1024


def drawn(sets: Sequence[Sequence[int]], counts: Sequence[int], labels: int, share: float) -> np.ndarray:
    """How many rows of each set of labels are held out.

    The label that fewest rows have left is served first (then that with the greater deficit, then the first), with a row of the set
    that covers most deficits (then with most labels, then the first); sets have many rows, so up to a 32nd of what is missing is
    taken at once. What then is missing comes from the sets in turn, in proportion to what they have left.
    """
    has = np.zeros((len(sets), labels), np.int64)
    for k, s in enumerate(sets):
        has[k, list(s)] = 1
    left, total = np.array(counts, np.int64), int(sum(counts))
    target = max(1, min(total - 1, round(total * share))) if total > 1 else 0
    wanted = np.rint((has * left[:, None]).sum(axis=0) * target / max(total, 1)).astype(np.int64)
    held, taken = np.zeros(labels, np.int64), np.zeros(len(sets), np.int64)
    while taken.sum() < target:
        missing, remaining = wanted - held, (has * left[:, None]).sum(axis=0)
        open_labels = np.flatnonzero((missing > 0) & (remaining > 0))
        if not len(open_labels):
            break
        label = min(open_labels, key=lambda x: (remaining[x], -missing[x], x))
        worth = has @ np.clip(missing, 0, None)
        k = max(np.flatnonzero((has[:, label] == 1) & (left > 0)), key=lambda x: (worth[x], has[x].sum(), -x))
        inside = missing[(has[k] == 1) & (missing > 0)]
        n = max(1, min(int(inside.min()), int(left[k]), target - int(taken.sum())) // 32)
        taken[k], left[k], held = taken[k] + n, left[k] - n, held + n * has[k]
    short = target - int(taken.sum())
    if short:
        even = np.floor(left * (short / left.sum())).astype(np.int64)
        for k in np.argsort(-(left * (short / left.sum()) - even), kind="stable")[: short - even.sum()]:
            even[k] += 1
        taken += even
    return taken


def multilabel_split(rows: DataFrame, key: str, labels: str, share: float) -> DataFrame:
    """rows with held_out: a `share` of all rows such that each label has its share of them. labels: an array; null and empty are alike.

    Rows with the same set of labels are alike to the draw, so only the sets and their counts, MOST_SETS at most, come to the driver;
    which rows of a set are taken follows from a hash of their keys, in slots of SLOTS.
    """
    named = rows.withColumn("_set", F.array_sort(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>")))))
    found = named.groupBy("_set").agg(F.count("*").alias("n")).orderBy("_set").limit(MOST_SETS + 1).collect()
    if len(found) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} different sets of labels")
    names = sorted({x for r in found for x in r["_set"]})
    place = {x: k for k, x in enumerate(names)}
    taken = drawn([[place[x] for x in r["_set"]] for r in found], [r.n for r in found], len(names), share) if found else []
    quota = rows.sparkSession.createDataFrame([(r["_set"], int(n)) for r, n in zip(found, taken)], "_set array<string>, _take long")
    hashed = named.withColumns({"_h": F.xxhash64(F.col(key)), "_slot": F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS))})
    slots = hashed.groupBy("_set", "_slot").agg(F.count("*").alias("_n"))
    slots = slots.withColumn("_before", F.sum("_n").over(Window.partitionBy("_set").orderBy("_slot")) - F.col("_n")).drop("_n")
    place_in = F.row_number().over(Window.partitionBy("_set", "_slot").orderBy("_h", key))
    ranked = hashed.withColumn("_k", place_in).join(slots, ["_set", "_slot"]).join(F.broadcast(quota), "_set")
    return ranked.withColumn("held_out", F.col("_k") + F.col("_before") <= F.col("_take")).drop("_set", "_h", "_slot", "_before", "_k", "_take")


def backed_off(rows: DataFrame, levels: Sequence[Sequence[str]], least: int) -> DataFrame:
    """rows with `stratum` and `level`: the first of levels (lists of columns, finest first) that at least `least` rows share; else all.

    Counts are combined before they are shuffled, and go back to the rows by a join that Spark can split where a stratum is large."""
    made, pick = rows, F.lit(None).cast("int")
    for k, columns in enumerate(levels):
        name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        made = made.withColumn(f"_s{k}", name)
        counts = made.groupBy(f"_s{k}").agg(F.count("*").alias(f"_n{k}"))
        made = made.join(counts, f"_s{k}")
    for k in reversed(range(len(levels))):
        pick = F.when(F.col(f"_n{k}") >= least, k).otherwise(pick)
    made = made.withColumn("level", F.coalesce(pick, F.lit(len(levels))))
    stratum = F.element_at(F.array(*[F.col(f"_s{k}") for k in range(len(levels))], F.lit("")), F.col("level") + 1)
    return made.withColumn("stratum", stratum).drop(*[f"_{x}{k}" for k in range(len(levels)) for x in "sn"])
