"""Predicates as columns. Null behaves as in SQL unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price buckets, [low, high), the last without an upper bound.
PRICE_BUCKETS: dict[str, tuple[float, float | None]] = {
    "0 - 100M": (0, 100e6), "100M - 250M": (100e6, 250e6), "250M - 500M": (250e6, 500e6), "500M - 750M": (500e6, 750e6), "750M - 1B": (750e6, 1e9),
    "1B - 5B": (1e9, 5e9), "5B - 10B": (5e9, 10e9), "10B - 20B": (10e9, 20e9), "20B - 50B": (20e9, 50e9), "50B+": (50e9, None),
}


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def in_years(date: Column, years: Sequence[int]) -> Column:
    """Any of half-open year ranges, so that a scan can skip row groups; year(date) could not be pushed down."""
    day = lambda y: F.lit(f"{y:04d}-01-01").cast("timestamp")
    return any_of([(date >= day(y)) & (date < day(y + 1)) for y in years])


def between_dates(date: Column, year_min: int | None = None, year_max: int | None = None, after: str | None = None, before: str | None = None) -> Column:
    """year_min and year_max both included, after included, before excluded; an absent bound holds for all."""
    parts = []
    if year_min is not None:
        parts.append(date >= F.lit(f"{year_min:04d}-01-01").cast("timestamp"))
    if year_max is not None:
        parts.append(date < F.lit(f"{year_max + 1:04d}-01-01").cast("timestamp"))
    if after is not None:
        parts.append(date >= F.lit(after).cast("timestamp"))
    if before is not None:
        parts.append(date < F.lit(before).cast("timestamp"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def facets(values: dict[str, Sequence]) -> Column:
    """All the facets' value lists hold; an empty list asks nothing."""
    return reduce(lambda a, b: a & b, [F.col(c).isin(list(v)) for c, v in values.items() if v], F.lit(True))


def in_buckets(value: Column, labels: Sequence[str], buckets: dict[str, tuple[float, float | None]] = PRICE_BUCKETS) -> Column:
    """Any of the named buckets; unknown labels are ignored, and no known label asks nothing."""
    number = value.try_cast("double")
    known = [buckets[x] for x in labels if x in buckets]
    return any_of([(number >= low) & (number < high if high is not None else F.lit(True)) for low, high in known]) if known else F.lit(True)


def bucket_of(value: Column, buckets: dict[str, tuple[float, float | None]] = PRICE_BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for label, (low, high) in reversed(buckets.items()):
        inside = (value >= low) & (value < high) if high is not None else value >= low
        out = F.when(inside, label).otherwise(out)
    return out


def flag_filter(flag: Column, values: Sequence[str]) -> Column:
    """Tri-state: 'true' asks for 1, 'false' for 0, others ask nothing; a null flag meets neither."""
    wanted = [{"true": 1, "false": 0}[v] for v in values if v in ("true", "false")]
    return flag.cast("int").isin(wanted) if wanted else F.lit(True)


def has_text(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def json_list_empty(value: Column) -> Column:
    return value.isNull() | value.isin("", "[]")


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def word_hit(text: Column, words: Sequence[str]) -> Column:
    """A word stands in the text with no letter or digit on either side, case aside."""
    return text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])")


#: What a heading says instead of a section.
EMPTY_HEADINGS = ("[reserved]", "[omitted]", "[intentionally deleted]", "[deleted]")


def eligible_title(article: Column, section: Column) -> Column:
    """Both headings have three characters or more, and the section's does not say that there is none."""
    long = lambda c: F.char_length(F.trim(F.coalesce(c, F.lit("")))) >= 3
    low = F.lower(F.coalesce(section, F.lit("")))
    return long(article) & long(section) & ~F.greatest(*[F.contains(low, F.lit(x)) for x in EMPTY_HEADINGS])


def summary_eligible(status: Column, gated: Column, verified: Column) -> Column:
    return (F.coalesce(F.lower(status), F.lit("")) != "invalid") & ~((F.coalesce(gated, F.lit(0)) == 1) & (F.coalesce(verified, F.lit(0)) == 0))


def public_eligible(gated: Column, verified: Column) -> Column:
    return (F.coalesce(gated, F.lit(0)) != 1) | (F.coalesce(verified, F.lit(0)) == 1)


def latest_ok(latest: Column, status: Column) -> Column:
    return (latest == 1) & (status.isNull() | (status == "verified"))


def missing_core(consideration: Column, total: Column, cash: Column, stock: Column, assets: Column, target: Column, acquirer: Column) -> Column:
    """Consideration and both parties' types have to be there. A price has to have a total and, paid in cash, its cash; in stock, its
    stock; mixed, two of its three parts. Blank text is missing; another kind of consideration asks for no price."""
    here = lambda c: F.coalesce(has_text(c.cast("string")), F.lit(False))
    kind = F.coalesce(consideration, F.lit(""))
    parts = here(cash).cast("int") + here(stock).cast("int") + here(assets).cast("int")
    enough = F.when(kind == "cash", here(cash)).when(kind == "stock", here(stock)).when(kind == "mixed", parts >= 2)
    return ~here(consideration) | ~here(target) | ~here(acquirer) | (kind.isin("cash", "stock", "mixed") & ~(enough & here(total)))


def clamp_page_size(asked: int | None, most: int, default: int = 25) -> int:
    return min(asked, most) if isinstance(asked, int) and asked > 0 else min(default, most)


def clamped_size(asked: Column, most: Column, default: int = 25) -> Column:
    """clamp_page_size as a column."""
    return F.when(asked > 0, F.least(asked, most)).otherwise(F.least(F.lit(default), most))
