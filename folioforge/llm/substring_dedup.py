"""Removal of repeated passages over all documents, by sharded suffix arrays.

A byte goes if a LENGTH-byte string that covers it also starts earlier. To meet, equal strings need one shard: of a string's
GRAM-byte grams the one with the least hash, the leftmost of equals, is its seed, and the seed's hash names the shard. Strings
that follow each other mostly have one seed, so a document gives one row for each seed, not for each string:

1.  documents are dealt out by id once; of equal documents only the first goes on, the others repeat it whole;
2.  a task gives the seeds of its documents. Of slices of text that it has met before, seed and all, only the spans go on, and
    of a seed it has met before one witness is counted for the task: so a very frequent seed is one row a task;
3.  seeds are counted; of those that occur twice or more the slices of text that hold their strings are cut out;
4.  in a shard equal slices collapse; of the others a suffix array is induced, and strings with a common prefix of LENGTH bytes
    with the one before are equal: all but the earliest are repeats;
5.  a seed with very many different slices goes without a suffix array: its strings are dealt out one by one, by their hash and
    a salt, equal ones collapse for each salt, and what is left of the salts meets again. A seed with more than HOT_SHARE's
    part of all bytes is treated so from the start; one over SHARD bytes, when a task finds that it has more than it may hold;
6.  the repeats' spans go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import HOT_SHARE
from folioforge.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 100, 24
#: Bytes whose seeds are found together, below 2^20; bytes of slices in one suffix array; most of one seed's.
TOGETHER, ARRAY, SHARD = 1 << 19, 1 << 20, 1 << 22
#: Repeated seeds, and bytes of slices, that a task remembers.
SEEDS, SLICES = 1 << 18, 1 << 25
#: Parts of an id that very many rows share, and of a very frequent string.
BUCKETS, SALTS = 1 << 12, 64
LEAST_ID = -(1 << 63)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Kinds of rows that find_seeds gives.
REPEAT, KNOWN, SINGLE, WITNESS = range(4)
PLACE = ("id", "bucket", "rep")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM = 24 bytes from each place on."""
    words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    n = len(data) - GRAM + 1
    h = words[:n] * MIX[0]
    for k in (1, 2):
        h ^= h >> np.uint64(29)
        h = (h + words[8 * k : 8 * k + n]) * MIX[k]
    h ^= h >> np.uint64(32)
    h *= MIX[3]
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def seeds(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text's number, first start, last start): the strings of a text that start in [first, last] have that seed."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for low in range(0, max(0, len(text) - LENGTH + 1), TOGETHER):
            part = text[low : low + TOGETHER + LENGTH - 1]
            held.append((i, low, part))
            size += len(part)
            if size >= TOGETHER // 2:
                yield seeds_of(held)
                held, size = [], 0
    if held:
        yield seeds_of(held)


def seeds_of(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    begins = sizes.cumsum() - sizes
    h = gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    at = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & low).astype(np.int64)
    starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begins, sizes)])
    at = at[starts]
    part = np.repeat(np.arange(len(parts)), sizes - LENGTH + 1)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    part = part[new]
    shift = np.array([low for _, low, _ in parts])[part] - begins[part]
    return h[at[new]].view(np.int64), np.array([i for i, _, _ in parts])[part], starts[new] + shift, starts[last] + shift


def repeats(slices: list[bytes], order: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice's number, first start, last start) of the strings that also start earlier in these slices; order: the slices' ranks."""
    sizes = np.array([len(s) for s in slices])
    begins = np.concatenate([[0], (sizes + 1).cumsum()[:-1]])
    n = int((sizes + 1).sum())
    text = np.zeros(n + 1, np.int64)  # ends in the sentinel
    text[:n] = np.frombuffer(b"".join([x for s in slices for x in (s, b"\0")]), np.uint8)
    text[:n] += 2
    text[begins + sizes] = 1  # a separator
    array = suffix_array(text, 258)
    shared = common_prefixes(text, array)[array] >= LENGTH
    owner = np.append(np.repeat(np.arange(len(slices)), sizes + 1), 0)
    offset = np.arange(n + 1) - begins[owner]
    # strings equal to a whole string are whole as well, so groups stay together when others drop out
    whole = offset[array] + LENGTH <= sizes[owner[array]]
    whole[0] = False
    array, shared = array[whole], shared[whole]
    group = np.cumsum(~shared) - 1
    many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    array, group = array[many], group[many]
    if not len(array):
        return
    rank = order[owner[array]] << 32 | offset[array]
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(rank, new), np.diff(np.append(new, len(group))))
    later = np.sort(array[rank > first])
    cut = np.flatnonzero(np.append(True, (later[1:] != later[:-1] + 1) | (owner[later[1:]] != owner[later[:-1]])))
    for a, b in zip(later[cut], later[np.append(cut[1:], len(later)) - 1]):
        yield int(owner[a]), int(offset[a]), int(offset[b])


Row = tuple[int, int, int, int, int, bytes | None]
SPANS = "id long, bucket int, rep int, first long, last long, string binary"


class Shard:
    """Folds rows (h, slice, place) in that order into repeated spans, (*place, first start, last start, None), and single
    strings of seeds too large to hold, (*place, start, start, string). place: id, bucket, rep; a slice has its first start.

    A row without a slice is a span already; a slice without h is a single string, dealt out before.
    """

    def __init__(self, array: int = ARRAY, most: int = SHARD):
        self.array, self.most = array, most
        self.slices, self.places, self.size = [], [], 0  # of groups that are over
        self.group, self.at, self.bytes, self.over = [], [], 0, False
        self.h = self.last = None

    def take(self, h: int | None, part: bytes, place: tuple[int, int, int], first: int) -> Iterator[Row]:
        if h != self.h:
            yield from self.close()
            self.h, self.last = h, None
        if part == self.last:
            yield (*place, first, first + len(part) - LENGTH, None)
            return
        self.last = part
        if self.over or h is None:
            yield from self.single(part, place, first)
            return
        self.group.append(part)
        self.at.append((place, first))
        self.bytes += len(part)
        if self.bytes > self.most:
            self.over = True
            for x, (y, k) in zip(self.group, self.at):
                yield from self.single(x, y, k)
            self.group, self.at, self.bytes = [], [], 0

    def single(self, part: bytes, place: tuple[int, int, int], first: int) -> Iterator[Row]:
        for k in range(len(part) - LENGTH + 1):
            yield (*place, first + k, first + k, part[k : k + LENGTH])

    def close(self) -> Iterator[Row]:
        """End of a seed; a seed with one slice repeats nothing."""
        if len(self.group) > 1:
            self.slices += self.group
            self.places += self.at
            self.size += self.bytes
        self.group, self.at, self.bytes, self.over = [], [], 0, False
        if self.size >= self.array:
            yield from self.sort()

    def sort(self) -> Iterator[Row]:
        if self.slices:
            order = np.empty(len(self.slices), np.int64)
            order[sorted(range(len(self.places)), key=self.places.__getitem__)] = np.arange(len(self.places))
            for k, a, b in repeats(self.slices, order):
                place, first = self.places[k]
                yield (*place, first + a, first + b, None)
        self.slices, self.places, self.size = [], [], 0


def batches_of(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [*PLACE, "first", "last", "string"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [*PLACE, "first", "last", "string"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


class Met:
    """What a task has met: seeds that it has sent a witness of, and the earliest place of each slice of a repeated seed."""

    def __init__(self):
        self.seeds, self.slices, self.size = np.zeros(0, np.int64), {}, 0

    def repeated(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each seed whether the task has met it before or h has it twice; and those of them that no witness stands for yet."""
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        if len(self.seeds):
            known = self.seeds[np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)] == h
        else:
            known = np.zeros(len(h), bool)
        new = np.unique(h[twice & ~known])
        if len(self.seeds) + len(new) > SEEDS:
            self.seeds = np.zeros(0, np.int64)  # later ones get a witness once more
        self.seeds = np.sort(np.concatenate([self.seeds, new]))
        return twice | known, new

    def before(self, part: bytes, place: tuple) -> bool:
        """Whether the same slice stands at an earlier place."""
        was = self.slices.get(part)
        if was is not None and was < place:
            return True
        if was is None:
            self.size += len(part)
            if self.size > SLICES:
                self.slices, self.size = {}, len(part)
        self.slices[part] = place
        return False


FOUND = "k long, id long, at long, h long, bucket int, rep int, kind int"


def find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND, few and small columns that compress well.

    k: what a row is dealt out by; the seed for SINGLE and WITNESS rows, which are counted, else a hash of its place. at: first
    start x 128 + starts after it. h: for KNOWN rows the seed, for REPEAT rows the last start.
    """
    met = Met()
    for batch in batches:
        ids, buckets, reps = (batch.column(c).to_numpy() for c in PLACE)
        texts = batch.column("data").to_pylist()
        for h, i, first, last in seeds(texts):
            repeated, new = met.repeated(h)
            out, run = [], None  # [seed or last start, text's number, first, starts after it, kind]
            for n in np.flatnonzero(repeated).tolist():
                k, a, b = int(i[n]), int(first[n]), int(last[n])
                if not met.before(texts[k][a : b + LENGTH], (int(ids[k]), int(buckets[k]), int(reps[k]), a)):
                    out.append((int(h[n]), k, a, b - a, KNOWN))
                elif run and run[1] == k and run[0] + 1 == a:
                    run[0] = b
                else:
                    run = [b, k, a, 0, REPEAT]
                    out.append(run)
            one = ~repeated
            yield found_batch(h[one], None, i[one], first[one], last[one] - first[one], np.full(int(one.sum()), SINGLE), ids, buckets, reps)
            if len(new):
                nothing = np.zeros(len(new), np.int64)
                yield found_batch(new, None, nothing, nothing, nothing, nothing + WITNESS, ids, buckets, reps)
            if out:
                own, k, a, more, kind = zip(*out)
                k, a = np.array(k), np.array(a)
                dealt = ((ids[k].view(np.uint64) * MIX[0]) ^ (a.astype(np.uint64) * MIX[1])).view(np.int64)
                yield found_batch(dealt, np.array(own), k, a, np.array(more), np.array(kind), ids, buckets, reps)


def found_batch(k, h, i, first, more, kind, ids, buckets, reps) -> pa.RecordBatch:
    at = first.astype(np.int64) << 7 | more
    own = pa.nulls(len(k), pa.int64()) if h is None else pa.array(h)
    arrays = [pa.array(k), pa.array(ids[i]), pa.array(at), own, pa.array(buckets[i]), pa.array(reps[i]), pa.array(kind.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["k", "id", "at", "h", "bucket", "rep", "kind"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are; of single strings, equal ones in order of place, all but the first."""

    def run():
        was = None
        for *place, first, last, string in rows_of(batches):
            if string is None or string == was:
                yield (*place, first, last, None)
            was = string

    yield from batches_of(run())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Removed runs [begin, end) of the strings that start in the spans; runs that touch are one."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + LENGTH)
        else:
            out.append([first, last + LENGTH])
    return [(a, b) for a, b in out]


def at_row(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on a document's place that keeps the partitioning by id and bucket: rep is a condition, not a key, which a join would
    deal out by as well."""
    right = other.withColumnsRenamed({c: f"_{c}" for c in PLACE})
    same = (F.col("id") == F.col("_id")) & (F.col("bucket") == F.col("_bucket")) & (F.col("rep") - F.col("_rep") == 0)
    return rows.join(right, same, how).drop(*[f"_{c}" for c in PLACE])


def remove_repeats(docs: DataFrame, array: int = ARRAY, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, [begin, end)), kept (the bytes left, binary); one row for each row of docs.

    A null text is empty; matches stay within a document; strings are judged on the input. Rows that repeat an id stand in order
    of a hash of their texts (its rest by BUCKETS), then of the texts; a null id stands as the least long. An id that more than
    HOT_SHARE's part of all rows have is dealt out by that hash as well. An empty table gives no rows; other columns are not read.
    """

    def find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run():
            fold = Shard(array, shard)
            for h, part, i, bucket, rep, first, last in rows_of(batches):
                if part is None:
                    yield (i, bucket, rep, first, last, None)
                else:
                    yield from fold.take(h, part, (i, bucket, rep), first)
            yield from fold.close()
            yield from fold.sort()

        yield from batches_of(run())

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    rows = few.withColumn("id", F.coalesce("doc_id", F.lit(LEAST_ID)))
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("data"))).first()
    hot_ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(1, total // HOT_SHARE)).select("id", F.lit(True).alias("_hot"))
    hashed = F.pmod(F.xxhash64("data"), F.lit(BUCKETS))
    bucket = F.coalesce(F.when(F.col("_hot"), hashed).cast("int"), F.lit(0))
    marked = rows.join(F.broadcast(hot_ids), "id", "left").select("doc_id", "id", bucket.alias("bucket"), "data")
    # every part below reads the same columns of the same exchange, so the texts are shuffled once; the keys can't be null, or the
    # joins would ask for that below the exchange, each in its own way
    within = Window.partitionBy("id", "bucket").orderBy(hashed, "data", F.col("doc_id").asc_nulls_first())
    dealt = marked.repartition("id", "bucket").withColumn("rep", F.row_number().over(within))
    # ordered rows of equal texts: of rows that repeat id and text the first has the least rep
    digests = dealt.select(*PLACE, F.unhex(F.sha2("data", 256)).alias("sha"))
    firsts = digests.groupBy("sha").agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*")
    found = at_row(dealt.filter(F.octet_length("data") >= LENGTH), firsts).select(*PLACE, "data").mapInArrow(find_seeds, FOUND)
    counted = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    twice = counted.filter((F.col("kind") < SINGLE) | ((F.col("kind") == SINGLE) & (F.col("_n") > 1)))
    first = F.shiftright("at", 7)
    last = F.when(F.col("kind") == REPEAT, F.col("h")).otherwise(first + F.col("at").bitwiseAND(127))
    twice = twice.select(F.when(F.col("kind") != REPEAT, F.coalesce("h", "k")).alias("h"), *PLACE, first.alias("first"), last.alias("last"), "kind")
    # bytes of a seed's slices; at most 5 x HOT_SHARE seeds have more than that part of all, as slices overlap less than 5-fold
    # (asking for the place, which is never null, keeps the columns of the exchange below the same as elsewhere, so that it is reused)
    there = F.col("id").isNotNull() & F.col("bucket").isNotNull() & F.col("rep").isNotNull()
    long = F.sum(F.when(there, F.col("last") - F.col("first") + LENGTH))
    hot = twice.filter(F.col("kind") != REPEAT).groupBy("h").agg(long.alias("_n")).filter(F.col("_n") > max(shard, (size or 0) // HOT_SHARE))
    routed = twice.join(F.broadcast(hot.select("h", F.lit(True).alias("_hot"))), "h", "left")
    # a slice, or of a hot seed its strings, each with its own first start
    step = F.when(F.col("_hot"), F.lit(LENGTH)).otherwise(F.col("last") - F.col("first") + LENGTH)
    starts = F.when(F.col("_hot"), F.sequence("first", "last")).otherwise(F.array("first"))
    parts = at_row(dealt, routed).withColumn("_start", F.explode(starts))
    part = F.when(F.col("kind") != REPEAT, F.substring(F.col("data"), (F.col("_start") + 1).cast("int"), step.cast("int")))
    slices = parts.select(F.when(F.col("_hot").isNull(), F.col("h")).alias("h"), part.alias("slice"), *PLACE, F.col("_start").alias("first"), "last")
    salted = F.xxhash64("slice", F.pmod(F.xxhash64("id", "bucket"), F.lit(SALTS)))
    key = F.when(F.col("slice").isNull(), F.xxhash64("id", "first")).otherwise(F.coalesce("h", salted))
    order = ("h", "slice", *PLACE, "first")
    spans = slices.withColumn("_k", key).repartition("_k").sortWithinPartitions(*order).drop("_k").mapInArrow(find_repeats, SPANS)
    key = F.when(F.col("string").isNull(), F.xxhash64("id", "first")).otherwise(F.xxhash64("string"))
    settled = spans.withColumn("_k", key).repartition("_k").sortWithinPartitions("string", *PLACE, "first").drop("_k").mapInArrow(settle, SPANS)
    by_document = settled.groupBy(*PLACE).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    whole = at_row(at_row(dealt, firsts.withColumn("_first", F.lit(True)), "left"), by_document, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for doc_id, data, first, spans in rows_of(batches):
            if first:
                runs = merged([(s["first"], s["last"]) for s in spans or []])
            else:
                runs = [(0, len(data))] if len(data) >= LENGTH else []
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            held.append((doc_id, len(data), [{"begin": a, "end": b} for a, b in runs], kept))
            size += len(data)
            if size >= TOGETHER:
                yield cleaned(held)
                held, size = [], 0
        if held:
            yield cleaned(held)

    def cleaned(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "spans", "kept"])

    return whole.select("doc_id", "data", "_first", "spans").mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    """Counts and a digest in place of the spans and bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
