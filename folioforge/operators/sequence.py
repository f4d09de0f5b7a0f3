"""Operators on ordered rows of a document: neighbours, runs, clamps, decoding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.names import own


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    (row,) = own(rows, "_row")
    return rows.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(row) <= n).drop(row)


def keep_last(rows: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Of rows with the same key the one that came last."""
    return first_n(rows, keys, [F.desc(arrival)], 1)


def neighbours(rows: DataFrame, key: str, order: str, columns: Sequence[str], default=0) -> DataFrame:
    """prev_c, next_c and the two absolute differences of each numeric column; `default` at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    made = {}
    for c in columns:
        before, after = F.coalesce(F.lag(c).over(w), F.lit(default)), F.coalesce(F.lead(c).over(w), F.lit(default))
        made |= {f"prev_{c}": before, f"next_{c}": after, f"prev_{c}_delta": F.abs(F.col(c) - before), f"next_{c}_delta": F.abs(F.col(c) - after)}
    return rows.withColumns(made)


def since_last(rows: DataFrame, key: str, order: str, hit: Column, recent: int = 5) -> DataFrame:
    """since: rows since the last hit, null before the first; seen: whether one came; recent_hits among the last `recent` rows, this one included."""
    w = Window.partitionBy(key).orderBy(order)
    ordinal = F.row_number().over(w)
    o, h = own(rows, "_o", "_h")
    made = rows.withColumns({o: ordinal, h: hit})
    last = F.last(F.when(F.col(h), F.col(o)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hits = F.sum(F.col(h).cast("int")).over(w.rowsBetween(1 - recent, 0))
    return made.withColumns({"since": F.col(o) - last, "seen": last.isNotNull(), "recent_hits": hits}).drop(o, h)


def relative_position(rows: DataFrame, key: str, order: str) -> DataFrame:
    """position in 0..1, and whether a row is in the first or last tenth or fifth of its document (at least one row is)."""
    n, k = F.count("*").over(Window.partitionBy(key)), F.row_number().over(Window.partitionBy(key).orderBy(order))
    made = rows.withColumns({"_n": n, "_k": k})
    part = lambda share: F.ceil(F.col("_n") * share)
    flags = {"position": F.when(F.col("_n") > 1, (F.col("_k") - 1) / (F.col("_n") - 1)).otherwise(0.0)}
    for name, share in (("decile", 0.1), ("quintile", 0.2)):
        flags |= {f"first_{name}": F.col("_k") <= part(share), f"last_{name}": F.col("_k") > F.col("_n") - part(share)}
    return made.withColumns(flags).drop("_n", "_k")


def monotone_clamp(rows: DataFrame, key: str, order: str, rank: str) -> DataFrame:
    """clamped: the greatest rank so far; modified where that changes the row."""
    clamped = F.max(rank).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("clamped", clamped).withColumn("modified", F.col("clamped") != F.col(rank))


def relabel_early_run(rows: DataFrame, key: str, order: str, label: str, early: str, trigger: str, instead: str, most: float = 0.5) -> DataFrame:
    """relabelled: `early` rows in the first `most` of a document, before any `trigger` row, become `instead`."""
    w = Window.partitionBy(key).orderBy(order)
    came = F.max(F.when(F.col(label) == trigger, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(w) / F.count("*").over(Window.partitionBy(key))
    return rows.withColumns({"_came": came, "_place": place}).withColumn("relabelled", F.when((F.col(label) == early) & (F.col("_came") == 0) & (F.col("_place") <= most), instead).otherwise(F.col(label))).drop("_came", "_place")


def islands(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """island: the number of the run of equal values that a row is in."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def longest_runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value, longest: the longest run of each value in each document."""
    runs = islands(rows, key, order, value).groupBy(key, value, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(key, value).agg(F.max("n").alias("longest"))


def sequence_gaps(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Rows whose number does not follow the one before (the first is to be 1), with what was expected."""
    expected = F.coalesce(F.lag(number).over(Window.partitionBy(key).orderBy(order)) + 1, F.lit(1))
    return rows.filter(F.col(number).isNotNull()).withColumn("expected", expected).filter(F.col(number) != F.col("expected"))


def out_of_order(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Rows whose number is below one that came before; such a row does not move what the next is held against."""
    most = F.max(number).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("most_before", most).filter(F.col(number) < F.col("most_before"))


def review_summary(rows: DataFrame, key: str, order: str, label: str, confidence: str, low: float) -> DataFrame:
    """A document's risk: pages, mean, least and worst-3 mean confidence, low pages, longest low run, label changes, and a weighted score."""
    w = Window.partitionBy(key).orderBy(order)
    made = rows.withColumns({"_low": F.col(confidence) < low, "_change": ~F.col(label).eqNullSafe(F.coalesce(F.lag(label).over(w), F.col(label)))})
    runs = longest_runs(made, key, order, "_low").filter("_low").select(key, F.col("longest").alias("longest_low_run"))
    worst = F.slice(F.array_sort(F.collect_list(confidence)), 1, 3)
    mean3 = F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.size(worst)
    out = made.groupBy(key).agg(
        F.count("*").alias("pages"), F.avg(confidence).alias("mean_confidence"), F.min(confidence).alias("least_confidence"), mean3.alias("worst3"), F.count_if("_low").alias("low_pages"), F.count_if("_change").alias("changes")
    )
    out = out.join(runs, key, "left").withColumn("longest_low_run", F.coalesce("longest_low_run", F.lit(0)))
    return out.withColumn("review_score", 0.5 * (1 - F.col("worst3")) + 0.3 * F.col("low_pages") / F.col("pages") + 0.2 * F.least(F.lit(1.0), F.col("longest_low_run") / 5))


#: Limits of a page's confidence, twice, of its margin, and of its risk.
LOW, VERY_LOW, LOW_MARGIN, HIGH_RISK = 0.6, 0.4, 0.2, 0.5


def review_features(rows: DataFrame, key: str, order: str, probabilities: dict[str, str], body: str, back: str) -> DataFrame:
    """A document's review features from its pages' label probabilities (label -> column).

    Pages of each label; boundaries (the label differs from the page before), turns from body to back; pages with low or very low
    confidence, low margin, high risk (1 - confidence x margin), or body and back within LOW_MARGIN of each other at the top, each in
    all, late (the last half or the last ten pages, whichever is fewer), at boundaries, and in the longest run; least, mean, and
    worst-3 and worst-5 mean confidence and margin; and the review score, a weighted sum.
    """
    ranked = F.sort_array(F.array(*[F.struct(F.col(c).alias("p"), F.lit(name).alias("name")) for name, c in probabilities.items()]), False)
    w = Window.partitionBy(key).orderBy(order)
    pages = F.count("*").over(Window.partitionBy(key))
    made = rows.select(key, order, ranked.alias("_r"), F.row_number().over(w).alias("_k"), pages.alias("_n"), F.col(probabilities[body]).alias("_b"), F.col(probabilities[back]).alias("_x"))
    made = made.withColumns({"_label": F.col("_r")[0]["name"], "_c": F.col("_r")[0]["p"], "_m": F.col("_r")[0]["p"] - F.col("_r")[1]["p"]})
    before = F.lag("_label").over(w)
    flags = {
        "boundary": before.isNotNull() & (before != F.col("_label")), "body_to_back": (before == body) & (F.col("_label") == back), "late": F.col("_k") > F.greatest(F.floor(F.col("_n") / 2), F.col("_n") - 10),
        "low_confidence": F.col("_c") < LOW, "very_low_confidence": F.col("_c") < VERY_LOW, "low_margin": F.col("_m") < LOW_MARGIN, "high_risk": 1 - F.col("_c") * F.col("_m") > HIGH_RISK,
        "competition": (F.abs(F.col("_b") - F.col("_x")) < LOW_MARGIN) & (F.greatest("_b", "_x") == F.col("_c")),
    }
    made = made.withColumns({f"f_{c}": v for c, v in flags.items()})
    runs = ("low_confidence", "very_low_confidence", "low_margin", "high_risk", "competition")
    # the place of a page less its place among pages with the same flag is one number for each run
    made = made.withColumns({f"g_{c}": F.col("_k") - F.row_number().over(Window.partitionBy(key, f"f_{c}").orderBy(order)) for c in runs})
    lengths = None
    for c in runs:
        one = made.filter(f"f_{c}").groupBy(key, f"g_{c}").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias(f"{c}_longest_run"))
        lengths = one if lengths is None else lengths.join(one, key, "full")
    count = lambda c, name: F.count_if(c).alias(name)
    parts = [count(F.col("_label") == name, f"{name}_pages") for name in probabilities]
    parts += [count(F.col("f_boundary"), "boundaries"), count(F.col("f_body_to_back"), "body_to_back")]
    parts += [count(F.col(f"f_{c}"), f"{c}_pages") for c in runs]
    parts += [count(F.col(f"f_{c}") & F.col("f_late"), f"late_{c}_pages") for c in ("low_confidence", "high_risk", "competition")]
    parts += [count(F.col(f"f_{c}") & F.col("f_boundary"), f"boundary_{c}_pages") for c in ("low_confidence", "high_risk")]
    for c, name in (("_c", "confidence"), ("_m", "margin")):
        least = F.array_sort(F.collect_list(c))
        mean = lambda k, v=least: F.aggregate(F.slice(v, 1, k), F.lit(0.0), lambda a, x: a + x) / F.least(F.size(v), F.lit(k))
        parts += [F.min(c).alias(f"least_{name}"), F.avg(c).alias(f"mean_{name}"), mean(3).alias(f"worst3_{name}"), mean(5).alias(f"worst5_{name}")]
    out = made.groupBy(key).agg(F.count("*").alias("pages"), *parts).join(lengths, key, "left")
    out = out.withColumns({f"{c}_longest_run": F.coalesce(f"{c}_longest_run", F.lit(0)) for c in runs})
    n = F.col("pages")
    score = 0.35 * (1 - F.col("worst3_confidence")) + 0.25 * F.col("high_risk_pages") / n + 0.2 * F.col("low_margin_pages") / n + 0.2 * F.least(F.lit(1.0), F.col("low_confidence_longest_run") / 5)
    return out.withColumn("review_score", score)


def monotone_viterbi(scores: np.ndarray) -> np.ndarray:
    """Labels that never fall, with the greatest sum of scores; scores: (rows, labels). Of equal paths the one with lower labels."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), int)
    for t in range(1, n):
        so_far = np.maximum.accumulate(best)
        first = np.array([int(np.flatnonzero(best[: j + 1] == so_far[j])[0]) for j in range(k)])
        back[t], best = first, so_far + scores[t]
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return np.array(path[::-1])


def decode_monotone(rows: DataFrame, key: str, order: str, scores: Sequence[str]) -> DataFrame:
    """key, order, decoded: the best never-falling label index of each document's rows. One document at a time."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        return pd.DataFrame({key: frame[key], order: frame[order], "decoded": monotone_viterbi(frame[list(scores)].to_numpy(float))})

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, decoded int")


def averaged_windows(rows: DataFrame, key: str, start: str, logits: str) -> DataFrame:
    """key, position, logit: overlapping windows' values averaged at each position."""
    at = rows.select(key, start, F.posexplode(logits).alias("_p", "_v"))
    return at.groupBy(key, (F.col(start) + F.col("_p")).alias("position")).agg(F.avg("_v").alias("logit"))


def bioes_labels(kinds: Sequence[str]) -> list[str]:
    """O, then B, I, E and S of each kind."""
    return ["O", *[f"{x}-{k}" for k in kinds for x in "BIES"]]


def bioes_allowed(labels: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which labels may start, end and follow each other: inside a span only I or E of its kind, elsewhere O, or a B or S."""
    inner = lambda x: x[0] in "BI"
    opens = np.array([x[0] in "OBS" for x in labels])
    follow = np.array([[(b[0] in "IE" and b[2:] == a[2:]) if inner(a) else o for b, o in zip(labels, opens)] for a in labels])
    return opens, np.array([not inner(x) for x in labels]), follow


def bioes_viterbi(scores: np.ndarray, labels: Sequence[str]) -> list[str]:
    """The allowed sequence of labels with the greatest sum of scores (rows, labels); of equal ones that with earlier labels, from the end."""
    start, stop, follow = bioes_allowed(labels)
    best = np.where(start, scores[0], -np.inf)
    back = np.zeros(scores.shape, int)
    for t in range(1, len(scores)):
        paths = np.where(follow, best[:, None], -np.inf)
        back[t] = paths.argmax(axis=0)
        best = paths.max(axis=0) + scores[t]
    at = int(np.where(stop, best, -np.inf).argmax())
    out = [at]
    for t in range(len(scores) - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return [labels[k] for k in out[::-1]]


def decode_bioes(rows: DataFrame, key: str, order: str, scores: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """key, order, decoded: the best valid BIOES labels of each document's rows; scores: a column for each of bioes_labels(kinds)."""
    labels = bioes_labels(kinds)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        return pd.DataFrame({key: frame[key], order: frame[order], "decoded": bioes_viterbi(frame[list(scores)].to_numpy(float), labels)})

    types = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {types[key]}, {order} {types[order]}, decoded string")
