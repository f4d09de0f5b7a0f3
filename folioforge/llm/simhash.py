"""SimHash near-dedup by anchor-point covering.

Fingerprints link at RADIUS = 3 or fewer differing bits of 64, so in one of the two 32-bit halves they differ in at most 1. Each
half's anchors are a covering code: the perfect Hamming code of length 31 times all values of the last bit, which covers every
32-bit word within 1. A fingerprint's home is its nearest anchor; it is replicated to every anchor within 1 + 1 of it. Then any
fingerprint linked to x by that half stands at x's home, and each anchor compares those at home with all that came.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import HOT_SHARE, cut, lookup, strings
from folioforge.llm.components import components
from folioforge.llm.exact_dedup import keep_rows, row_key

RADIUS = 3
#: Shingles whose bits are counted together; members compared in one block; members of an anchor that goes to several tasks.
TOGETHER, DENSE, SPLIT = 1 << 16, 512, 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); a text without words has 0."""
    tokens = text.encode().lower().split() if text else []  # bytes: both take ASCII alone
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)])) if len(tokens) >= words else [b" ".join(tokens)]
    n = max(1, len(tokens) - words + 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits, as a signed long, that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), TOGETHER):
        counts += np.unpackbits(hashes[at : at + TOGETHER].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (long) for each row, and the columns in also; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64()), *[batch.column(c) for c in also]], ["doc_id", "fp", *also])

    schema = ", ".join(["doc_id long", "fp long", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in also]])
    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(run, schema)


def syndromes(bits: int, first: int) -> np.ndarray:
    """For each word of so many bits the XOR of its set bits' positions, counted from first."""
    table = np.zeros(1 << bits, np.uint32)
    for bit in range(bits):
        table[1 << bit : 2 << bit] = table[: 1 << bit] ^ np.uint32(bit + first)
    return table


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit words (as uint64): rows (word's place, anchor, whether it is the word's home) for all anchors within 2."""
    low, last = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    low_part, high_part = (low & np.uint64(0xFFFF)).astype(np.int64), (low >> np.uint64(16)).astype(np.int64)
    syndrome = (syndromes(16, 1)[low_part] ^ syndromes(15, 17)[high_part]).astype(np.int64)
    flip = np.concatenate([[0], np.uint64(1) << np.arange(31, dtype=np.uint64)]).astype(np.uint64)
    near = low ^ flip[syndrome]
    place = np.arange(len(half))
    out = [(place, near | last, np.ones(len(half), bool)), (place, near | (last ^ np.uint64(0x80000000)), np.zeros(len(half), bool))]
    for i in range(1, 32):
        j = syndrome ^ i
        use = np.flatnonzero((syndrome > 0) & (j > i))  # j = 0 is the nearest anchor itself; each pair once
        out.append((use, (low[use] ^ flip[i] ^ flip[j[use]]) | last[use], np.zeros(len(use), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def replicas(nodes: DataFrame) -> DataFrame:
    """anchor, fp, home for every fp (long), twice: once for each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for low in range(0, len(every), 20_000):
                fps = every[low : low + 20_000]
                for side in (0, 1):
                    place, anchor, home = anchors((fps >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF))
                    key = (anchor | np.uint64(side << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[place].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def close(fps: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within RADIUS among one anchor's members, one of each pair at home, found block by block; of each block a spanning forest."""
    n = len(fps)
    for at in range(0, n, DENSE):
        rows = np.arange(at, min(n, at + DENSE))
        for to in range(at, n, DENSE):
            columns = np.arange(to, min(n, to + DENSE))
            near = np.bitwise_count(fps[rows, None] ^ fps[None, columns]) <= RADIUS
            near &= home[rows, None] | home[None, columns]
            a, b = np.nonzero(near)
            a, b = rows[a], columns[b]
            use = a < b
            yield from forest(a[use], b[use], n)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """At most one link for each node, that connect what the links a-b connect."""
    if len(a) < 64:
        if len(a):
            yield a, b
        return
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b):
            np.minimum.at(new, x, low)
            np.minimum.at(new, root[x], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    use = np.flatnonzero(root != np.arange(len(nodes)))
    yield nodes[use], nodes[root[use]]


def compare(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, split: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the members of each anchor; the rows stand in anchor order. split: its members are a part of an anchor."""
    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(edges, len(anchor)))
    some = np.logical_or.reduceat(home, edges) & (sizes > 1)
    small = some & (sizes <= 16)
    keep = np.repeat(small, sizes)
    a, f, h = anchor[keep], fps[keep], home[keep]
    for k in range(1, 16):
        if len(a) <= k:
            break
        same = np.flatnonzero(a[k:] == a[:-k])
        if not len(same):
            break
        near = same[(np.bitwise_count(f[same] ^ f[same + k]) <= RADIUS) & (h[same] | h[same + k])]
        if len(near):
            yield f[near], f[near + k]
    for g in np.flatnonzero(some & ~small):
        part = slice(edges[g], edges[g] + sizes[g])
        f, h = fps[part], home[part]
        if len(f) <= 4 * DENSE or split[edges[g]]:
            for x, y in close(f, h):
                yield f[x], f[y]
            continue
        # members that link differ in at most RADIUS bits of the other half, so one of its four bytes is the same
        for byte in range(4):
            value = (f >> np.uint64((0 if int(anchor[edges[g]]) >> 32 else 32) + 8 * byte)) & np.uint64(255)
            order = np.argsort(value, kind="stable")
            for low, high in zip(*(np.searchsorted(value[order], np.arange(256), s) for s in ("left", "right"))):
                inner = order[low:high]
                for x, y in close(f[inner], h[inner]):
                    yield f[inner][x], f[inner][y]


def links(nodes: DataFrame) -> DataFrame:
    """u, v: links between different fps, enough of them to connect all that link; not all pairs of a dense group.

    An anchor with over SPLIT members, or more than its part of all where that is more, is dealt out by the bytes of the other
    half: members that link agree in one of those four, so each goes to four tasks of some 1024.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of anchors that may go on
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))]
            if not len(now[0]):
                continue
            ends = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last anchor may go on
            if held and held[0][0][-1] != now[0][-1]:
                done = [np.concatenate(x) for x in zip(*held, [x[:ends] for x in now])]
                yield from batches_of(compare(*done))
                held = []
            elif ends:
                yield from batches_of(compare(*[x[:ends] for x in now]))
            held.append([x[ends:] for x in now])
        if held:
            yield from batches_of(compare(*[np.concatenate(x) for x in zip(*held)]))

    def batches_of(found):
        for x, y in found:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["u", "v"])

    # a fp has at most 2 x 34 replicas, so at most 34 x HOT_SHARE anchors have more members than this
    most = max(SPLIT, 2 * nodes.count() // HOT_SHARE)
    every = replicas(nodes)
    dense = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("anchor", F.lit(True).alias("dense"))
    marked = every.join(F.broadcast(dense), "anchor", "left")
    other = [F.when(F.shiftright("anchor", 32) > 0, F.shiftrightunsigned("fp", 8 * b)).otherwise(F.shiftrightunsigned("fp", 32 + 8 * b)).bitwiseAND(255) for b in range(4)]
    keys = F.when(F.col("dense"), F.array(*[F.xxhash64("anchor", F.lit(b), x) for b, x in enumerate(other)])).otherwise(F.array("anchor"))
    dealt = marked.select(F.explode(keys).alias("key"), "fp", "home", F.coalesce("dense", F.lit(False)).alias("split"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def find_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable), component_size; one row for each row.

    Null and empty texts have fingerprint zero and link like any other. Null ids count for no component's least id, so a
    component of such rows alone has a null id. Copies share a fingerprint and meet once; only different fingerprints are
    compared, and of a dense group only a spanning forest of its links is written.
    """
    rows = cut(fingerprints(docs, words))
    total = rows.count()
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")))
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a window would meet a large component in one task; its least id comes from a combined aggregate instead
    rooted = cut(rooted)
    of = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("_n").alias("component_size"), F.count(F.lit(1)).alias("_m"))
    named = lookup(rooted.select("fp", "root", "_n"), of, ["root"], "_m", max(1, total)).select("fp", "_n", "component_id", "component_size")
    out = lookup(rows, cut(named), ["fp"], "_n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of docs that stay, all columns: of each component exactly one, the one with the least doc_id that is not null.

    Rows go by id and text, so that null and repeated ids of different texts are kept apart.
    """
    rows = fingerprints(docs.select("doc_id", "text", row_key().alias("key")), words, ["key"])
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    firsts = nodes.join(found, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(docs, firsts.select("first.key"))
