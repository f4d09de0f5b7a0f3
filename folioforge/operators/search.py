"""Search: prefix and id resolution, offset and keyset pages, counts, previews."""

from __future__ import annotations

import base64
import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.names import own
from folioforge.operators.rollups import running


def prefix_search(rows: DataFrame, column: str, asked: str, year_of: str | None = None) -> DataFrame:
    """Rows whose column starts with what is asked, case aside; four digits ask for a year where there is a date."""
    if year_of and asked.strip().isdigit() and len(asked.strip()) == 4:
        from folioforge.functions.predicates import in_years

        return rows.filter(in_years(F.col(year_of), [int(asked)]))
    return rows.filter(F.startswith(F.lower(F.col(column)), F.lit(asked.lower())))


def project(rows: DataFrame, key: str, asked: Sequence[str]) -> DataFrame:
    """The key and the known fields asked for; with none asked, all."""
    known = [c for c in asked if c in rows.columns and c != key]
    return rows.select(key, *known) if asked else rows


def resolve_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Each id asked for, and whether it is known; none is dropped in silence."""
    column = asked.columns[0]
    there = known.select(column).distinct().withColumn("known", F.lit(True))
    return asked.join(there, column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def default_context(rows: DataFrame, column: str, left_out: str, asked: bool) -> DataFrame:
    """A context that is left out unless asked for."""
    return rows if asked else rows.filter(F.col(column) != left_out)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1 on, with has_next; one row more than a page is looked at."""
    window = Window.orderBy(*order)
    taken = rows.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    (row,) = own(taken, "_row")
    ranked = taken.withColumn(row, F.row_number().over(window)).withColumn("has_next", F.lit(False) | (F.count("*").over(Window.partitionBy(F.lit(0))) > size))
    return ranked.filter(F.col(row) <= size).drop(row)


def keyset_order(column: str, key: str, descending: bool) -> list[Column]:
    """Nulls last in both directions, the key ascending among equals."""
    c = F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc()]


def keyset_after(column: str, key: str, descending: bool, value, last_key) -> Column:
    """Rows after the one with that value and key in keyset_order; a null value stands among the nulls at the end."""
    c, k = F.col(column), F.col(key)
    if value is None:
        return c.isNull() & (k > last_key)
    beyond = c < F.lit(value) if descending else c > F.lit(value)
    return beyond | ((c == F.lit(value)) & (k > last_key)) | c.isNull()


def encode_cursor(value, key) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, key], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    try:
        value, key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, TypeError) as error:
        raise ValueError("not a cursor") from error
    return value, key


def queue(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next rows of a scan by key."""
    return (rows if last is None else rows.filter(F.col(key) > last)).orderBy(key).limit(size)


def top_by(rows: DataFrame, groups: Sequence[str], ranks: dict[str, Sequence[Column]], k: int) -> DataFrame:
    """Rows among the first k of a group by any of the orders, with each order's rank."""
    for name, order in ranks.items():
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return rows.filter(reduce(lambda a, b: a | b, [F.col(name) <= k for name in ranks]))


def capped_groups(rows: DataFrame, group: str, order: Sequence[Column], most: int, matched: Column) -> DataFrame:
    """The first `most` matching rows of a group, with how many matched, whether some were left out, and how many there are."""
    everything = Window.partitionBy(group)
    m, row = own(rows, "_m", "_row")
    counted = rows.withColumns({m: matched, "total_count": F.count("*").over(everything), "matched_count": F.count_if(matched).over(everything)})
    ranked = counted.filter(F.col(m)).withColumn(row, F.row_number().over(everything.orderBy(*order)))
    return ranked.filter(F.col(row) <= most).withColumn("truncated", F.col("matched_count") > most).drop(m, row)


def budget_prefix(rows: DataFrame, lead: str, order: Sequence[Column], cost: str, budget: float) -> DataFrame:
    """Rows in order while their summed cost is within the budget; the first that overflows ends it. lead: the order's first column."""
    return running(rows, lead, order, {"so_far": F.col(cost)}).filter(F.col("so_far") <= budget)


def hydrate(ids: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Details of a page's ids in the page's order (column `ordinal`); an id without details is an error when the row is read."""
    (there,) = own(details.join(ids.limit(0), key, "full"), "_there")
    joined = ids.join(details.withColumn(there, F.lit(True)), key, "left")
    checked = F.when(F.col(there).isNull(), F.raise_error(F.concat(F.lit("no details for "), F.col(key).cast("string")))).otherwise(F.col("ordinal"))
    return joined.withColumn("ordinal", checked.cast("int")).drop(there)


def seeded_sample(rows: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """A sample that stays the same for a seed."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(size)


class CountMemo:
    """Counts by filter signature, for a while, the least recently used dropped first."""

    def __init__(self, seconds: float = 300, most: int = 512, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, OrderedDict()

    @staticmethod
    def signature(filters: dict) -> str:
        return hashlib.sha1(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()

    def count(self, filters: dict, make: Callable[[], int]) -> int:
        key, now = self.signature(filters), self.clock()
        if key in self.held and self.held[key][1] > now:
            self.held.move_to_end(key)
            return self.held[key][0]
        self.held[key] = (make(), now + self.seconds)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return self.held[key][0]


def lower_bound(page_number: int, size: int, on_page: int, has_next: bool) -> int:
    """What a page shows of a count that is not made."""
    return (page_number - 1) * size + on_page + (1 if has_next else 0)
