"""Aggregations: trends, coverage, leaderboards, histograms, metrics and intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.names import own

#: Upper bounds in milliseconds; a tenth slot takes what is above.
LATENCY_BOUNDS = (25, 50, 100, 250, 500, 1000, 2000, 5000, 10000)


def money(column: str) -> Column:
    """Exact sums of amounts: whole cents."""
    return F.col(column).cast("decimal(18,2)")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the values over 0; a group without any keeps its row, with nulls."""
    over = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy(*keys).agg(*[F.percentile(over, F.lit(p)).alias(name) for name, p in points.items()])


def dense_grid(rows: DataFrame, grid: DataFrame, keys: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Every cell of the grid; missing counts are 0, other missing values null."""
    return grid.join(rows, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def facet_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n of several columns in one pass; blank values do not count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").filter(F.trim("value") != "").groupBy("facet", "value").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, fields: dict[str, tuple[Column, Column]], scope: Column | None = None) -> DataFrame:
    """field (and scope), eligible, covered and pct of fields given as (eligible, covered) conditions, in one pass.

    pct has one digit, halves to even, and is null where nothing is eligible.
    """
    made = [F.struct(F.lit(name).alias("field"), e.alias("e"), (e & c).alias("c")) for name, (e, c) in fields.items()]
    keys = ["field"] if scope is None else ["scope", "field"]
    long = rows.select(*([] if scope is None else [scope.alias("scope")]), F.explode(F.array(*made)).alias("f")).select(*keys[:-1], "f.*")
    out = long.groupBy(*keys).agg(F.count_if("e").alias("eligible"), F.count_if("c").alias("covered"))
    return out.withColumn("pct", F.when(F.col("eligible") > 0, F.bround(F.col("covered") * 100.0 / F.col("eligible"), 1)))


def bucket_slot(value: Column, bounds: Sequence[float] = LATENCY_BOUNDS) -> Column:
    """The first slot whose bound is not below the value; the last for all above."""
    out = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        out = F.when(value <= bounds[k], k).otherwise(out)
    return out


def histogram(value: Column, bounds: Sequence[float] = LATENCY_BOUNDS) -> Column:
    """An aggregate: counts by slot, as an array."""
    slot = bucket_slot(value, bounds)
    return F.array(*[F.count_if((slot == k) & value.isNotNull()) for k in range(len(bounds) + 1)])


def usage_rollup(events: DataFrame, keys: Sequence[str], time: str, value: str, unit: str = "hour") -> DataFrame:
    """Events by key and time slot: count, total, most and histogram of a value."""
    return events.groupBy(*keys, F.date_trunc(unit, time).alias("slot")).agg(F.count("*").alias("n"), F.sum(money(value)).cast("double").alias("total"), F.max(value).alias("most"), histogram(F.col(value)).alias("buckets"))


def mode_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Each key's display name: the most frequent, then the longest, then the first in lower case, then the first."""
    counted = rows.groupBy(key, name).agg(F.count("*").alias("_n"))
    order = [F.desc("_n"), F.desc(F.length(name)), F.lower(name), F.col(name)]
    return counted.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_row = 1").select(key, name)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a proportion, within 0 and 1; null where n is 0."""
    p = F.when(n > 0, hits / n)
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)


def bootstrap(rows: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """key, mean, low, high: a seeded percentile interval of the mean of each group's values.

    A group's values are first counted, so that a task gets one row for each distinct value and not the group's rows; a resample
    of n rows is then a multinomial draw of those counts.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(value)
        x, n = frame[value].to_numpy(float), frame["n"].to_numpy()
        r = np.random.default_rng(seed)
        means = np.array([r.multinomial(n.sum(), n / n.sum()) @ x / n.sum() for _ in range(resamples)])
        return pd.DataFrame({key: [frame[key].iloc[0]], "mean": [float(x @ n / n.sum())], "low": [float(np.quantile(means, low))], "high": [float(np.quantile(means, high))]})

    kind = dict(rows.dtypes)[key]
    return counted.groupBy(key).applyInPandas(draw, f"`{key}` {kind}, mean double, low double, high double")


def phi(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of two 0/1 columns; null where one of them has one value."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = rows.filter(both).groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"))
    c = F.col
    spread = (c("_n") * c("_xx") - c("_x") * c("_x")) * (c("_n") * c("_yy") - c("_y") * c("_y"))
    return sums.select(*keys, F.when(spread > 0, F.try_divide(c("_n") * c("_xy") - c("_x") * c("_y"), F.sqrt(spread))).alias("phi"))


def mined_rules(rows: DataFrame, title: str, label: str, support: int, precision: float, margin: float) -> DataFrame:
    """Titles whose first label is frequent, precise and ahead of the second: title, label, n, precision, margin."""
    counted = rows.groupBy(title, label).agg(F.count("*").alias("n"))
    by_title = Window.partitionBy(title)
    share = F.col("n") / F.sum("n").over(by_title)
    ranked = counted.withColumns({"precision": share, "_row": F.row_number().over(by_title.orderBy(F.desc("n"), label)), "_next": F.coalesce(F.lead("n").over(by_title.orderBy(F.desc("n"), label)), F.lit(0))})
    ranked = ranked.filter("_row = 1").withColumn("margin", F.col("precision") - F.col("precision") * F.col("_next") / F.col("n"))
    return ranked.filter((F.col("n") >= support) & (F.col("precision") >= precision) & (F.col("margin") >= margin)).select(title, label, "n", "precision", "margin")


def class_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 from pairs of labels; undefined shares are 0."""
    pairs = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("t")), F.struct(F.col(guess).alias("label"), F.lit(False).alias("t")))).alias("s"), "n", (F.col(truth) == F.col(guess)).alias("hit")).select("s.*", "n", "hit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = sides.groupBy("label").agg(total(F.col("t") & F.col("hit")).alias("tp"), total(~F.col("t") & ~F.col("hit")).alias("fp"), total(F.col("t") & ~F.col("hit")).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def average_metrics(per_class: DataFrame) -> DataFrame:
    """One row from class_metrics: accuracy, and precision, recall and f1 as macro, micro and support-weighted means."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    support = F.col("tp") + F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    means = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [share(F.sum(F.col(c) * support), F.sum(support)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    micro = [share(tp, tp + fp).alias("micro_precision"), share(tp, tp + fn).alias("micro_recall"), share(2 * tp, 2 * tp + fp + fn).alias("micro_f1")]
    return per_class.agg(share(tp, tp + fn).alias("accuracy"), *means, *micro, *weighted)


def set_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row for sets of labels (arrays): rows, subset_accuracy (both sets equal), and micro precision, recall and f1 over their members."""
    a, b = F.array_distinct(F.coalesce(truth, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(guess, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(a, b))
    made = rows.select(F.size(a).alias("t"), F.size(b).alias("g"), both.alias("c"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    t, g, c = (F.sum(x) for x in "tgc")
    equal = F.avg(((F.col("t") == F.col("c")) & (F.col("g") == F.col("c"))).cast("int"))
    return made.agg(F.count("*").alias("n"), equal.alias("subset_accuracy"), share(c, g).alias("micro_precision"), share(c, t).alias("micro_recall"), share(2 * c, t + g).alias("micro_f1"))


def mined_pair_rules(rows: DataFrame, outer: str, inner: str, label: str, support: int, precision: float, margin: float) -> DataFrame:
    """mined_rules of pairs of titles, as of an article and its section."""
    paired = rows.withColumn("_pair", F.struct(outer, inner))
    return mined_rules(paired, "_pair", label, support, precision, margin).select("_pair.*", label, "n", "precision", "margin")


def running(rows: DataFrame, lead: str, order: Sequence[Column], sums: dict[str, Column], descending: bool = False, parts: int = 200) -> DataFrame:
    """rows with running sums in a total order whose first column is `lead`, a number, not null.

    No task gets all rows: they fall into ranges of `lead` between quantiles, sums run within a range, and each range starts from
    the total of those before, a table of `parts` rows at most that is broadcast.
    """
    bounds = sorted(set(rows.approxQuantile(lead, [k / parts for k in range(1, parts)], 0.25 / parts)))
    part = F.size(F.filter(F.array(*[F.lit(float(x)) for x in bounds]), lambda x: x < F.col(lead).cast("double"))) if bounds else F.lit(0)
    (at,) = own(rows, "_part")
    value = dict(zip(sums, own(rows, *[f"_v_{c}" for c in sums])))
    base = dict(zip(sums, own(rows, *[f"_b_{c}" for c in sums])))
    made = rows.withColumns({at: -part if descending else part, **{value[c]: v for c, v in sums.items()}})
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = made.groupBy(at).agg(*[F.sum(value[c]).alias(value[c]) for c in sums])
    starts = totals.select(at, *[F.coalesce(F.sum(value[c]).over(before), F.lit(0)).alias(base[c]) for c in sums])
    within = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = made.join(F.broadcast(starts), at)
    out = out.withColumns({c: F.col(base[c]) + F.sum(value[c]).over(within) for c in sums})
    return out.drop(at, *value.values(), *base.values())


def ntiles(rows: DataFrame, lead: str, order: Sequence[Column], k: int, name: str) -> DataFrame:
    """rows with `name`: which of k parts of equal size, the first ones larger by one, a row falls into in that order (see running)."""
    n = rows.count()
    ranked = running(rows, lead, order, {"_rank": F.lit(1)})
    small, more = n // k, n % k
    split = more * (small + 1)
    rank = F.col("_rank") - 1
    late = F.floor((rank - split) / max(1, small)) + more if small else F.lit(k - 1)
    return ranked.withColumn(name, (F.when(rank < split, F.floor(rank / (small + 1))).otherwise(late) + 1).cast("int")).drop("_rank")


def cut_edges(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the interval (edges[k], edges[k + 1]] a value lies in, the first with its lower edge; null outside."""
    out = F.lit(None).cast("string")
    for k, label in enumerate(labels):
        low = (value >= edges[k]) if k == 0 else (value > edges[k])
        out = F.when(low & (value <= edges[k + 1]), label).otherwise(out)
    return out


def best_threshold(rows: DataFrame, score: str, positive: str, target: float) -> DataFrame:
    """One row: the threshold (score >= it is flagged) that reaches the target recall with the fewest flagged, then the best
    precision, f1 and the highest threshold; if none does, the one with the best recall."""
    by_score = rows.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col(positive) == 1).alias("p")).filter("threshold IS NOT NULL")
    everything = by_score.agg(F.sum("p")).first()[0] or 0
    made = running(by_score, "threshold", [F.desc("threshold")], {"flagged": F.col("n"), "hits": F.col("p")}, descending=True)
    made = made.withColumns({"precision": F.col("hits") / F.col("flagged"), "recall": F.col("hits") / everything if everything else F.lit(0.0)})
    f1 = F.when(F.col("hits") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    made = made.withColumn("f1", f1).withColumn("feasible", F.col("recall") >= target)
    order = [F.desc("feasible"), F.when(F.col("feasible"), -F.col("flagged")).otherwise(F.col("recall")).desc(), F.desc("precision"), F.desc("f1"), F.desc("threshold")]
    return made.orderBy(*order).limit(1).select("threshold", "flagged", "hits", "precision", "recall", "f1", "feasible")


def split_report(rows: DataFrame, split: str, label: str) -> DataFrame:
    """Each label's share in each split."""
    counted = rows.groupBy(split, label).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def worst_mean(values: Column, k: int) -> Column:
    """The mean of the k least of an array; of all if there are fewer."""
    few = F.slice(F.array_sort(values), 1, k)
    return F.aggregate(few, F.lit(0.0), lambda a, x: a + x) / F.size(few)




def mean_complexity(rows: DataFrame) -> DataFrame:
    """rows with `complexity`: the mean of the logarithm of the words and of the grade, each scaled to 0..1 over all rows, and of
    `several`; a grade that is null does not count. rows: see functions.text.complexity."""
    ends = [f(c).alias(f"_{n}_{c}") for c in ("log_words", "grade") for n, f in (("low", F.min), ("high", F.max))]
    wide = rows.crossJoin(F.broadcast(rows.agg(*ends)))  # one row
    scaled = lambda c: F.when(F.col(c).isNull(), None).when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), (F.col(c) - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}"))).otherwise(0.0)
    parts = F.array_compact(F.array(scaled("log_words"), scaled("grade"), F.col("several")))
    return wide.withColumn("complexity", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).drop(*[f"_{n}_{c}" for c in ("log_words", "grade") for n in ("low", "high")])
