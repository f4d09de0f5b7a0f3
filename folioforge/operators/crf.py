"""A linear-chain conditional random field over the ordered rows of documents, trained where the rows are.

A chain's score is the sum of its rows' label scores (linear in the features), of a weight for each two labels in a row, and of one
each for its first and last label. Every evaluation of the loss is one pass: a task runs forward and backward over batches of
chains and gives one gradient, and the tasks' gradients are added by position. The driver holds the weights alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.sets import checkpointed

#: Rows that are looked at together, whole chains at a time.
TOGETHER = 1 << 14
#: Of a forbidden step: no path of other steps can make up for it.
NEVER = -1e6


@dataclass(frozen=True)
class Weights:
    """rows (labels, features), bias, start and stop (labels), steps (label before, label)."""

    rows: np.ndarray
    bias: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    steps: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, labels: int, features: int) -> Weights:
        sizes = [labels * features, labels, labels, labels, labels * labels]
        rows, bias, start, stop, steps = np.split(flat, np.cumsum(sizes)[:-1])
        return cls(rows.reshape(labels, features), bias, start, stop, steps.reshape(labels, labels))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.rows, self.bias, self.start, self.stop, self.steps)])


@dataclass(frozen=True)
class Model:
    """What predict needs: the labels' names, each feature's mean and spread, and the weights."""

    labels: tuple[str, ...]
    means: np.ndarray
    spreads: np.ndarray
    weights: Weights


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Chains:
    """Chains laid out by their rows' places: longest first, so that the chains that have a row t are the first ones of the batch."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.begins = (np.cumsum(lengths) - lengths)[self.order]
        live = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(1, int(lengths.max(initial=0)) + 1), "left")
        #: For each place t the rows of all chains that reach so far.
        self.at = [self.begins[:n] + t for t, n in enumerate(live)]
        self.ends = self.begins + self.lengths - 1


def forward(scores: np.ndarray, chains: Chains, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over all beginnings up to each row and label, and of each chain over all of its labellings."""
    sums = np.zeros(scores.shape)
    for t, at in enumerate(chains.at):
        sums[at] = scores[at] + (w.start if not t else log_sum(sums[chains.at[t - 1][: len(at)], :, None] + w.steps, 1))
    return sums, log_sum(sums[chains.ends] + w.stop, 1)


def backward(scores: np.ndarray, chains: Chains, w: Weights) -> np.ndarray:
    sums = np.zeros(scores.shape)
    sums[chains.ends] = w.stop
    for t in range(len(chains.at) - 2, -1, -1):
        at, after = chains.at[t], chains.at[t + 1]
        at = at[: len(after)]
        sums[at] = log_sum(w.steps + (scores[after] + sums[after])[:, None, :], 2)
    return sums


def loss(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, w: Weights) -> tuple[float, np.ndarray]:
    """The negative log likelihood of labelled chains and its gradient. features: a row each, chain after chain; lengths: of each chain."""
    scores = features @ w.rows.T + w.bias
    chains = Chains(lengths)
    before, whole = forward(scores, chains, w)
    after = backward(scores, chains, w)
    totals = np.zeros(len(scores))
    for at in chains.at:
        totals[at] = whole[: len(at)]
    share = np.exp(before + after - totals[:, None])
    steps = np.zeros(w.steps.shape)
    for last, at in zip(chains.at, chains.at[1:]):
        last = last[: len(at)]
        steps += np.exp(before[last][:, :, None] + w.steps + (scores[at] + after[at] - totals[at, None])[:, None, :]).sum(axis=0)
    k = len(w.bias)
    first = np.zeros(len(labels), bool)
    first[chains.begins] = True
    follows = np.flatnonzero(~first)
    said = scores[np.arange(len(labels)), labels].sum() + w.start[labels[chains.begins]].sum() + w.stop[labels[chains.ends]].sum() + w.steps[labels[follows - 1], labels[follows]].sum()
    share[np.arange(len(labels)), labels] -= 1
    np.subtract.at(steps, (labels[follows - 1], labels[follows]), 1)
    expected = np.exp(before + after - totals[:, None])
    count = lambda rows: np.bincount(labels[rows], minlength=k)
    parts = Weights(share.T @ features, share.sum(axis=0), expected[chains.begins].sum(axis=0) - count(chains.begins), expected[chains.ends].sum(axis=0) - count(chains.ends), steps)
    return float(whole.sum() - said), parts.flat()


def best_labels(features: np.ndarray, lengths: np.ndarray, w: Weights) -> np.ndarray:
    """The labelling of the greatest score of each chain; of equal ones the smaller labels, from the end."""
    scores = features @ w.rows.T + w.bias
    chains = Chains(lengths)
    best, back = np.zeros(scores.shape), np.zeros(scores.shape, np.int64)
    for t, at in enumerate(chains.at):
        if not t:
            best[at] = scores[at] + w.start
            continue
        paths = best[chains.at[t - 1][: len(at)], :, None] + w.steps
        back[at], best[at] = paths.argmax(axis=1), paths.max(axis=1) + scores[at]
    out = np.zeros(len(scores), np.int64)
    out[chains.ends] = (best[chains.ends] + w.stop).argmax(axis=1)
    for last, at in reversed(list(zip(chains.at, chains.at[1:]))):
        out[last[: len(at)]] = back[at, out[at]]
    return out


def descended(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """A minimum of a smooth function by limited-memory quasi-Newton steps with halving; value: the function and its gradient."""
    x, pairs = start, []
    now, slope = value(x)
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance * max(1.0, np.abs(x).max()):
            break
        way, seen = slope.copy(), []
        for s, y, rate in reversed(pairs):
            seen.append(rate * (s @ way))
            way -= seen[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(slope))
        for (s, y, rate), a in zip(pairs, reversed(seen)):
            way += (a - rate * (y @ way)) * s
        size = 1.0
        while True:
            then, next_slope = value(x - size * way)
            if then <= now - 1e-4 * size * (slope @ way):
                break
            size /= 2
            if size < 1e-8:
                return x
        moved, turned = -size * way, next_slope - slope
        if moved @ turned > 1e-12:
            pairs = [*pairs, (moved, turned, 1 / (moved @ turned))][-memory:]
        x, now, slope = x + moved, then, next_slope
    return x


def chained(rows: DataFrame, key: str, order: str, features: Column, label: Column) -> DataFrame:
    """key, orders, features, labels: a row for each document, its rows in order. A document is one chain and is read whole."""
    at = F.struct(F.col(order).alias("o"), features.cast("array<double>").alias("f"), label.alias("l"))
    inside = rows.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("_r"))
    take = lambda c: F.transform("_r", lambda r: r[c])
    return inside.select(key, take("o").alias("orders"), take("f").alias("features"), take("l").alias("labels"))


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of whole chains with about TOGETHER rows."""
    lengths = batch.column("features").value_lengths().to_numpy(zero_copy_only=False)
    start, rows = 0, 0
    for k, n in enumerate(lengths):
        rows += n
        if rows >= TOGETHER or k == len(lengths) - 1:
            yield start, k + 1 - start
            start, rows = k + 1, 0


def matrix(part: pa.Array, width: int) -> np.ndarray:
    return part.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(rows: DataFrame, key: str, order: str, features: Column, label: Column, labels: Sequence[str], strength: float = 1.0, steps: int = 40) -> Model:
    """A model of documents whose rows are all labelled with one of labels; others are not used.

    features: an array of numbers, as many in each row, none null. They are scaled by the mean and spread of all rows. strength is
    that of the squared weights' sum in the loss; steps bounds the passes over the data, a few more for halved steps.
    """
    names = F.array(*[F.lit(x) for x in labels])
    number = F.when(F.array_contains(names, label), F.array_position(names, label) - 1).cast("int")
    chains = chained(rows, key, order, features, number).filter(F.forall("labels", lambda x: x.isNotNull()))
    held = checkpointed(chains.select("features", "labels"))
    wide = held.select(F.explode("features").alias("f")).select(F.posexplode("f").alias("at", "x"))
    moments = wide.groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).orderBy("at").collect()
    if not moments:
        raise ValueError("no document has all its rows labelled")
    means, spreads = np.array([m.mean for m in moments]), np.array([m.spread or 1.0 for m in moments])
    k, d = len(labels), len(moments)

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, total = Weights.of(flat, k, d), np.zeros(len(flat) + 1)
            for batch in batches:
                for at, n in batches_of(batch):
                    part, said = batch.column("features").slice(at, n), batch.column("labels").slice(at, n)
                    worth, slope = loss((matrix(part, d) - means) / spreads, said.flatten().to_numpy(zero_copy_only=False).astype(np.int64), part.value_lengths().to_numpy(zero_copy_only=False), w)
                    total[0] += worth
                    total[1:] += slope
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "x"])

        sums = held.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(len(flat) + 1)
        for r in sums:
            total[r["at"]] = r.x
        return total[0] + strength / 2 * (flat @ flat), total[1:] + strength * flat

    flat = descended(value, np.zeros(k * d + 3 * k + k * k), steps)
    return Model(tuple(labels), means, spreads, Weights.of(flat, k, d))


def predict(model: Model, rows: DataFrame, key: str, order: str, features: Column, rising: bool = False) -> DataFrame:
    """key, order, predicted of every row. rising: labels never fall back to one that stands before in model.labels."""
    w, d = model.weights, len(model.means)
    if rising:
        w = Weights(w.rows, w.bias, w.start, w.stop, np.where(np.tril(np.ones(w.steps.shape, bool), -1), NEVER, w.steps))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in batches_of(batch):
                part = batch.column("features").slice(at, n)
                lengths = part.value_lengths().to_numpy(zero_copy_only=False)
                found = best_labels((matrix(part, d) - model.means) / model.spreads, lengths, w)
                keys = batch.column(key).slice(at, n).take(pa.array(np.repeat(np.arange(n), lengths)))
                yield pa.RecordBatch.from_arrays([keys, batch.column("orders").slice(at, n).flatten(), pa.array([model.labels[x] for x in found], pa.string())], [key, order, "predicted"])

    chains = chained(rows, key, order, features, F.lit(0)).select(key, "orders", "features")
    return chains.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, predicted string")
