"""The survivor of each group of duplicates: a fold in order of date, summed up per range of dates so that no task gets a whole group.

Two copies meet: the more recent stays, unless it has less than half of the other's pages. The rule is not transitive, so a group is
folded in order: by date, then by place. Within one date recency goes on by time and address; a copy that comes in from an earlier date
is less recent than all that follow. Whether it stays then depends on its pages alone: the first copy with at least half of them takes
its place, and what becomes of that one does not depend on what it replaced. So a range of whole dates comes down to a short list: for
each copy that has more pages than all before it, the survivor if this is the first to win; such lists are applied one after the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of dates, give or take one date.
RANGE = 100_000
RATIO = 0.5
SUMMARY = "part long, n int, pages long, id long, its long"


def replaces(pages: int, held: int, newer: bool) -> bool:
    """Whether a copy takes the place of the one held."""
    if newer:
        return not (held > 0 and pages < RATIO * held)
    return pages > 0 and held < RATIO * pages


def summed_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a range's rows (date, place, seen, url, pages, id) in order: for each copy with more pages than all before, the survivor of the
    range if it is the first to stay (id, with its pages as `its`)."""
    rows = rows.sort_values(["date", "place"], kind="stable")
    keys = list(zip(rows.date, rows.seen, rows.url))
    pages, ids = rows.pages.tolist(), rows.id.tolist()
    records, most = [], -1
    for k, n in enumerate(pages):
        if n > most:
            records.append(k)
            most = n
    wanted, out = set(records), {}
    # from the end: what becomes of a copy is what becomes of the first that replaces it; walked once for each record
    for k in sorted(wanted, reverse=True):
        at = k
        for j in range(k + 1, len(pages)):
            if replaces(pages[j], pages[at], keys[j] > keys[at]):
                at = j
                if at in out:
                    at = out[at]
                    break
        out[k] = at
    made = [(k, pages[k], ids[out[k]], pages[out[k]]) for k in records]
    return pd.DataFrame(made, columns=["n", "pages", "id", "its"])


def folded(parts: pd.DataFrame) -> tuple[int, int]:
    """The survivor of a group's ranges in order, and its pages."""
    held, its = None, 0
    for _, part in parts.sort_values(["part", "n"]).groupby("part", sort=True):
        for r in part.itertuples():
            if held is None or replaces(r.pages, its, True):
                held, its = r.id, r.its
                break
    return held, its


def group_survivors(rows: DataFrame, group: str) -> DataFrame:
    """group, survivor, pages of each group. rows: group, id (long), date, place (long: order within a date), seen (timestamp), url, pages.

    Null pages count as none, a null `seen` as the earliest, a null url as empty; rows without a date come before all others. All rows
    of one date and group are looked at together; dates are dealt to ranges by running sums of their counts, one number a date."""
    kind = dict(rows.dtypes)[group]
    zero = F.lit("0001-01-01")
    plain = rows.select(
        F.col(group).alias("_g"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("date").cast("date"), zero.cast("date")).alias("date"), F.coalesce(F.col("place").cast("long"), F.lit(0)).alias("place"),
        F.coalesce(F.date_format("seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")).alias("seen"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("pages").cast("long"), F.lit(0)).alias("pages"),
    )
    dates = plain.groupBy("_g", "date").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_g").orderBy("date")) - F.col("n")
    dealt = _dealt(plain, dates, before)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        made = summed_up(frame)
        made.insert(0, "_g", [key[0]] * len(made))
        made.insert(1, "part", key[1])
        return made

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        survivor, pages = folded(frame)
        return pd.DataFrame({group: [key[0]], "survivor": [survivor], "pages": [pages]})

    parts = dealt.groupBy("_g", "part").applyInPandas(one, f"_g {kind}, {SUMMARY}")
    return parts.groupBy("_g").applyInPandas(whole, f"`{group}` {kind}, survivor long, pages long")


def _dealt(rows: DataFrame, dates: DataFrame, before: Column) -> DataFrame:
    """rows with the number of their range; groups may be null."""
    named = dates.select(F.col("_g").alias("_h"), F.col("date").alias("_d"), F.floor(before / RANGE).cast("long").alias("part"))
    return rows.join(named, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("date") == F.col("_d"))).drop("_h", "_d")
