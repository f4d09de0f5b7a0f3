"""Phrases: runs of words counted over a corpus, without those that are parts of longer ones."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let
from folioforge.operators import sketch as S
from folioforge.operators.sets import checkpointed

#: Words a phrase neither begins nor ends with.
STOPS = (
    "the", "a", "an", "of", "to", "in", "on", "at", "for", "and", "or", "but", "with", "by", "as", "is", "are", "was", "were", "be", "been", "being",
    "that", "this", "these", "those", "it", "its",
)
#: Limits of a phrase's shift over periods.
LEAST_DOCS, LEAST_SHARE, LEAST_EFFECT, FLAT, SPIKE = 10, 0.05, 0.10, 0.05, 0.10


def named(rows: DataFrame, words: str, least: int, most: int, stops: Sequence[str] = ()) -> DataFrame:
    """rows, each once for every run of least to most of its words that neither begins nor ends with a stop word: n, at (its place,
    from 1 on), and 128 bits, a and b, that stand for its words: 16 bytes are shuffled and compared where a phrase may have a hundred.

    A row first becomes one for each place, with the `most` words from there on, and that one for each length; so hashes are made
    outside of lambdas, in generated code, and no row carries more than `most` words.
    """
    keep = [c for c in rows.columns if c != words]
    places = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (least - 1)), lambda i: F.slice(w, i, most))
    # words may be an expression, which must not be worked out again for each place
    ahead = let(F.col(words), lambda w: F.when(F.size(w) >= least, places(w)))
    placed = rows.select(*keep, F.posexplode(ahead).alias("at", "_w"))
    if stops:
        placed = placed.filter(~F.get("_w", F.lit(0)).isin(*stops))
    cut = placed.select(*keep, (F.col("at") + 1).alias("at"), "_w", F.explode(F.sequence(F.lit(least), F.size("_w"))).alias("n"))
    if stops:
        cut = cut.filter(~F.get("_w", F.col("n") - 1).isin(*stops))
    run = F.slice("_w", F.lit(1), F.col("n"))
    return cut.select(*keep, "n", "at", F.xxhash64(run).alias("a"), F.xxhash64(F.lit(1), run).alias("b"))


NAME = ("a", "b")


#: Words that are looked at together.
TOGETHER = 1 << 20
#: Slots that the first search for the most widespread phrases goes through, for each phrase that is wanted.
FIRST = 64


class Runs:
    """The words of some documents in one array. ids: a number for each, by `spelling`; row: of which document; left: words from here to
    its end; a missing word parts runs."""

    def __init__(self, words: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        self.spelling, self.rows = coded.dictionary, len(sizes)
        self.ids = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        places = np.arange(len(self.ids))
        self.left = ends[self.row] - places if len(places) else places
        gaps = np.flatnonzero(self.ids < 0)
        if len(gaps):
            next_gap = np.searchsorted(gaps, places)
            self.left = np.minimum(self.left, np.append(gaps, len(places))[next_gap] - places)

    def slots(self, n: int) -> np.ndarray:
        """The slot of the run of n words from each place on; -1 where there are not so many."""
        # straight from the buffer: as Python strings they would take most of the time
        spelt = self.spelling.cast(pa.large_string())
        _, bounds, data = spelt.buffers()
        bounds = np.frombuffer(bounds, np.int64)[spelt.offset : spelt.offset + len(spelt) + 1].tolist() if len(spelt) else []
        data = memoryview(data) if data else b""
        hashes = np.array([crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])], np.uint64)
        out = np.full(len(self.ids), -1, np.int64)
        at = np.flatnonzero(self.left >= n)
        sums = np.zeros(len(at), np.uint64)
        for k in range(n):
            sums = S.mixed(sums + hashes[self.ids[at + k]])
        out[at] = (sums % np.uint64(S.SLOTS)).astype(np.int64)
        return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some TOGETHER words; a longer document is a part of its own."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and held + n > TOGETHER:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def sketched(docs: DataFrame, least: int, sketches: int = 1) -> np.ndarray:
    """For each slot how many documents have a run of `least` words in it. docs: words, and in `period` the sketch they count in."""

    def counts(batch: pa.RecordBatch, held: np.ndarray) -> None:
        for part in slices(batch):
            runs, period = Runs(part.column("words")), part.column("period").to_numpy(zero_copy_only=False)
            slot = runs.slots(least)
            of = period[runs.row]
            keep = (slot >= 0) & (of >= 0) & (of < sketches)
            # sorted, which is many times as fast as np.unique's table
            pairs = np.sort(runs.row[keep] * S.SLOTS + slot[keep])
            row, slot = np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]], S.SLOTS)
            for k in range(sketches):
                held[k] += np.bincount(slot[period[row] == k], minlength=S.SLOTS).astype(np.int32)

    return S.summed(docs.select("words", "period"), counts, sketches)


def counted(docs: DataFrame, least: int, most: int, frequent: np.ndarray, stops: Sequence[str], periods: int = 1) -> DataFrame:
    """text, n, docs_0 ... (documents of each period), occurrences, first (doc_id, at): the runs of words that neither begin nor end with
    a stop word and of which all inner runs of `least` words fall into slots that are `frequent` in one sketch. docs: doc_id (one row
    each), words without blanks, period (a number). A task's documents are counted together, so that few rows are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(held.value, axis=1).astype(bool)
        for batch in batches:
            for part in slices(batch):
                yield from found(part, wanted)

    def found(part: pa.RecordBatch, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        runs, period = Runs(part.column("words")), part.column("period").to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(runs.ids):
            return
        slot = runs.slots(least)
        good = wanted[:, slot] & (slot >= 0)
        stop = np.isin(runs.spelling.to_numpy(zero_copy_only=False), list(stops))
        order = pc.sort_indices(part.column("doc_id"), null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.flatnonzero(good.any(axis=0))
        at = at[~stop[runs.ids[at]]]
        alive, name = good[:, at], np.zeros(len(at), np.int64)
        for n in range(1, most + 1):
            if n > least:
                on = runs.left[at] >= n
                at, alive, name = at[on], alive[:, on], name[on]
                alive = alive & good[:, at + n - least]
                on = alive.any(axis=0)
                at, alive, name = at[on], alive[:, on], name[on]
            if not len(at):
                return
            # equal runs get equal names, which are numbers of this part
            name = np.unique(name * len(runs.spelling) + runs.ids[at + n - 1], return_inverse=True)[1]
            if n < least:
                continue
            ends = ~stop[runs.ids[at + n - 1]]
            here, row = at[ends], runs.row[at[ends]]
            if not len(here):
                continue
            each, first, times = np.unique((name[ends] * periods + period[row]) * runs.rows + rank[row], return_index=True, return_counts=True)
            kind, begins, size = np.unique(each // runs.rows, return_index=True, return_counts=True)
            place = here[first[begins]]
            text = pc.binary_join_element_wise(*[runs.spelling.take(pa.array(runs.ids[place + k])) for k in range(n)], " ")
            yield pa.RecordBatch.from_arrays(
                [
                    text, pa.array(np.full(len(kind), n, np.int32)), pa.array(kind % periods), pa.array(size.astype(np.int64)), pa.array(np.add.reduceat(times, begins).astype(np.int64)),
                    part.column("doc_id").take(pa.array(runs.row[place])), pa.array(place - runs.starts[runs.row[place]] + 1),
                ],
                ["text", "n", "period", "docs", "times", "doc_id", "at"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "words", "period").mapInArrow(run, f"text string, n int, period long, docs long, times long, doc_id {kind}, at long")
    each = [F.sum(F.when(F.col("period") == p, F.col("docs")).otherwise(0)).alias(f"docs_{p}") for p in range(periods)]
    return rows.groupBy("text", "n").agg(*each, F.sum("times").alias("occurrences"), F.min(F.struct("doc_id", "at")).alias("first"))


def one_row_each(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, words and what to keep), rows of one id put together if there are any, with a missing word between them."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs
    apart = F.concat("words", F.array(F.lit(None).cast("string")))
    return docs.groupBy("doc_id", *keep).agg(F.flatten(F.collect_list(apart)).alias("words"))


def named_phrases(found: DataFrame) -> DataFrame:
    """found, with `phrase` (an array of words) and its name, read more than once and so written."""
    words = found.withColumn("phrase", F.split("text", " "))
    return checkpointed(words.withColumns({"a": F.xxhash64("phrase"), "b": F.xxhash64(F.lit(1), "phrase")}))


def parts(phrases: DataFrame, least: int, most: int, *keep: str) -> DataFrame:
    """a and b of each shorter run of words in each phrase, and the columns to keep."""
    shorter = phrases.select(*keep, "phrase", F.size("phrase").alias("_size")).filter(F.col("_size") > least)
    return named(shorter, "phrase", least, most - 1).filter(F.col("n") < F.col("_size")).select(*keep, *NAME)


def top_phrases(docs: DataFrame, words: str = "words", least: int = 3, most: int = 6, least_docs: int = 2, k: int = 40, stops: Sequence[str] = STOPS) -> DataFrame:
    """phrase, docs, occurrences, n, rank: the k phrases that most documents have, of equals the longer, then the more frequent, then
    the one that stands first. A phrase inside a longer one that as many documents have is left out.

    docs: doc_id and an array of words without blanks. Documents are first counted by the slots of their shortest runs, and runs are
    counted exactly where all of theirs lie in slots that enough documents have: no phrase with so many documents is left out. If fewer
    than k phrases come of it, that number is lowered, to least_docs in the end. Every phrase then sends its shorter runs with its own
    count to be joined, whatever lies between them, as a run between two phrases may begin with a stop word and so be none itself.
    """
    rows = one_row_each(docs.select("doc_id", F.col(words).alias("words"))).withColumn("period", F.lit(0).cast("long"))
    sketch = sketched(rows, least)
    bar = max(least_docs, int(np.partition(sketch[0], -min(FIRST * k, S.SLOTS))[-min(FIRST * k, S.SLOTS)]))
    while True:
        exact = counted(rows, least, most, sketch >= bar, stops).withColumnRenamed("docs_0", "docs")
        enough = named_phrases(exact.filter(F.col("docs") >= bar))
        inner = parts(enough, least, most, "docs").distinct()
        left = enough.join(inner, [*NAME, "docs"], "left_anti")
        if bar <= least_docs or left.limit(k).count() >= k:
            break
        bar = max(least_docs, bar // 4)
    ordered = left.orderBy(F.desc("docs"), F.desc("n"), F.desc("occurrences"), "first").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("docs"), F.desc("n"), F.desc("occurrences"), "first"))
    return ordered.select(F.col("text").alias("phrase"), "docs", "occurrences", "n", rank.alias("rank"))


def shift_shape(shares: Sequence[Column], least_effect: float = LEAST_EFFECT, flat: float = FLAT, spike: float = SPIKE) -> Column:
    """The course of a phrase's share over periods: steady increase or decrease, late jump, mid-period spike, or mixed."""
    steps = [b - a for a, b in zip(shares, shares[1:])]
    net, highest, lowest = shares[-1] - shares[0], F.greatest(*steps), F.least(*steps)
    quiet = F.greatest(*[F.abs(s) for s in steps[:-1]]) < flat
    interior = F.greatest(*shares[1:-1])
    return (
        F.when((net >= least_effect) & (lowest >= -flat), "steady increase")
        .when((net <= -least_effect) & (highest <= flat), "steady decrease")
        .when(quiet & (steps[-1] >= least_effect), "late jump")
        .when((interior >= shares[0] + spike) & (interior >= shares[-1] + spike), "mid-period spike")
        .otherwise("mixed")
    )


def collapsed(ranked: DataFrame, keys: Sequence[str], least: int, most: int, k: int) -> DataFrame:
    """What is left when phrases are taken in the order of `rank` until k are held: one that is part of a held phrase is not taken,
    and a held one that is part of the next is given up. ranked: keys, rank, a, b, phrase (an array of words).

    After r phrases those are held that are part of none of the others. So a phrase comes in unless a longer one has a smaller rank,
    and goes at the first longer one with a greater rank; running sums of what comes and goes give the rank at which k are held.
    Phrases ranked here have passed a least share of documents, so that their number is bounded by the length of a document.
    """
    held = ranked.select(*keys, "rank", *NAME)
    longer = parts(ranked, least, most, *keys, "rank").withColumnRenamed("rank", "by")
    met = held.join(longer, [*keys, *NAME]).groupBy(*keys, "rank").agg(F.min("by").alias("earliest"), F.min(F.when(F.col("by") > F.col("rank"), F.col("by"))).alias("goes"))
    live = ranked.join(met, [*keys, "rank"], "left").filter(F.col("earliest").isNull() | (F.col("earliest") > F.col("rank")))
    steps = live.select(*keys, "rank", F.lit(1).alias("step")).unionByName(live.filter("goes IS NOT NULL").select(*keys, F.col("goes").alias("rank"), F.lit(-1).alias("step")))
    sums = steps.groupBy(*keys, "rank").agg(F.sum("step").alias("step")).withColumn("held", F.sum("step").over(Window.partitionBy(*keys).orderBy("rank")))
    full = sums.groupBy(*keys).agg(F.min(F.when(F.col("held") >= k, F.col("rank"))).alias("stop"))
    kept = live.join(full, list(keys)).filter((F.col("stop").isNull() | (F.col("rank") <= F.col("stop"))) & (F.col("goes").isNull() | (F.col("goes") > F.col("stop"))))
    return kept.drop("earliest", "goes", "stop")


def shifted_phrases(
    docs: DataFrame, period: str, periods: Sequence, noisy, words: str = "words", least: int = 2, most: int = 15, k: int = 15,
    least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_effect: float = LEAST_EFFECT,
) -> DataFrame:
    """direction (addition or deletion), rank, phrase, n, share_0 ..., delta, shape: the k phrases whose share of a period's documents
    grew, and fell, most from the first period to the last, without phrases inside others (collapsed).

    docs: doc_id, period, words. noisy: says of a phrase, as a string column, that it is left out. A phrase has to stand in
    least_docs documents and a least_share of one period, and to move by least_effect. Documents of other periods do not count.
    """
    number = F.coalesce(*[F.when(F.col(period) == p, F.lit(i).cast("long")) for i, p in enumerate(periods)])
    inside = docs.filter(F.col(period).isin(*periods)).select("doc_id", number.alias("period"), F.col(words).alias("words"))
    totals = {r.period: r["count"] for r in inside.groupBy("period").count().collect()}
    inside = one_row_each(inside, "period")
    total = [totals.get(i, 0) for i in range(len(periods))]
    # a share moves by no more than the greater of the two, so that the two periods' documents tell which runs can have moved enough
    ends = (0, len(periods) - 1)
    order = {i: k for k, i in enumerate(dict.fromkeys(ends))}
    place = F.coalesce(*[F.when(F.col("period") == i, F.lit(k).cast("long")) for i, k in order.items()], F.lit(-1).cast("long"))
    sketch = sketched(inside.withColumn("period", place), least, len(order))
    bars = [max(0, math.ceil((least_effect - 1e-9) * total[i])) if total[i] or least_effect <= 0 else 1 for i in order]
    per = counted(inside, least, most, np.stack([s >= b for s, b in zip(sketch, bars)]), (), len(periods))
    names = [f"share_{i}" for i in range(len(periods))]
    enough = per.filter(F.greatest(*[F.col(f"docs_{i}") for i in range(len(periods))]) >= least_docs)
    shared = enough.select("text", "n", *[(F.col(f"docs_{i}") / F.lit(total[i]) if total[i] else F.lit(0.0)).alias(s) for i, s in enumerate(names)])
    moved = shared.withColumn("delta", F.col(names[-1]) - F.col(names[0])).filter((F.greatest(*names) >= least_share) & (F.abs("delta") >= least_effect))
    clean = named_phrases(moved.filter(~noisy(F.col("text"))))
    sides = clean.withColumn("direction", F.explode(F.array(F.lit("addition"), F.lit("deletion"))))
    up = F.col("direction") == "addition"
    order = [F.desc(F.when(up, F.col("delta")).otherwise(-F.col("delta"))), F.desc("n"), F.desc(F.length("text")), F.desc(F.when(up, F.col(names[-1])).otherwise(F.col(names[0]))), F.asc("text")]
    ranked = sides.withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(*order)))
    left = collapsed(checkpointed(ranked), ["direction"], least, most, k)
    return left.select("direction", "rank", F.col("text").alias("phrase"), "n", *names, "delta", shift_shape([F.col(s) for s in names], least_effect).alias("shape"))
