"""Near-dedup by Jaccard similarity: links are pairs of texts whose sets of WORDS-word shingles have a similarity of LEAST or more.

Candidates come from the SimHash operator first: fingerprints of the same shingle sets, linked by its anchors (simhash.links). Then
those that it can't see, being few bits apart at very high similarity alone, come from MinHash: they agree in all ROWS values of one
of BANDS bands of their signatures, and a pair at 0.8 is missed with probability 7e-5, a closer one less often. Every candidate is
settled by its exact similarity.

Texts of one component are not compared any more. In a bucket one member is compared with all others; in large ones then two, four
and so on, as long as that settles half of what is left. The rest is compared where a bucket's members meet, by odd sketches, which
tell a lower bound of how many shingles two sets differ in: only pairs that may be similar by it leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import simhash
from folioforge.llm.common import cut, fitted, lookup, shared_dir, strings, trimmed
from folioforge.llm.components import components
from folioforge.llm.exact_dedup import keep_rows, normalised, row_key

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Words whose hashes a task remembers; shingles whose values are taken together; members of a bucket in each of the two parts that
#: are compared in one group; bits of the smallest and the largest odd sketch.
MEMO, TOGETHER, PART, BITS = 1 << 17, 1 << 11, 1 << 10, (1 << 10, 1 << 16)
#: Members of a bucket for which one round of leaders will do; pairs of a member that leave a task in the first round, and how many
#: times more in each other one.
LARGE, FEW, MORE = 1 << 12, 8, 64
_random = np.random.default_rng(42)
_PLACES, _FUNCTIONS, _JOINS = (_random.integers(0, 2**64, n, np.uint64) | np.uint64(1) for n in (WORDS * 8, BANDS * ROWS, ROWS))


class Words(dict):
    """XXH64 of words, as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, memo: Words, words: int = WORDS) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles; a text of fewer words is one shingle, one without words an empty one."""
    tokens = text.encode().lower().split() if text else []  # bytes: both take ASCII alone
    hashes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    span, n = min(words, len(tokens)), max(1, len(tokens) - words + 1)
    total = np.full(n, span, np.uint64)
    for k in range(span):
        total += mixed(hashes[k : k + n] * _PLACES[k])
    return np.unique(mixed(total))


def buckets(shingles: np.ndarray) -> np.ndarray:
    """For each band one number, equal where all the band's least values are."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), TOGETHER):
        np.minimum(least, (shingles[at : at + TOGETHER, None] * _FUNCTIONS).min(axis=0), out=least)
    bands = mixed(least.reshape(BANDS, ROWS)) * _JOINS
    return mixed(bands.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Bit c tells whether an odd number of shingles fall into cell c. Two sets' sketches differ in no more bits than the sets in
    shingles. A set of twice the size has twice the cells; a sketch folds to half its cells by XOR of its halves."""
    cells = BITS[0]
    while cells < min(BITS[1], 2 * len(shingles)):
        cells *= 2
    return np.packbits(np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(one: bytes, other: bytes) -> int:
    """A number of shingles that two texts differ in at least, by their odd sketches."""
    short, long = sorted((one, other), key=len)
    bits, size = int.from_bytes(long, "little"), len(long)
    while size > len(short):
        size //= 2
        bits = (bits >> 8 * size) ^ (bits & ((1 << 8 * size) - 1))
    return (bits ^ int.from_bytes(short, "little")).bit_count()


def may_be(differ, total, least: float):
    """Whether sets of so many shingles in all, that differ in so many, have a similarity of least or more: (total - differ) / (total + differ)."""
    return differ * (1 + least) <= total * (1 - least) + 1e-6


def texts(docs: DataFrame) -> DataFrame:
    """node, sha, size, bands, sketch, fp, first: each different text with the row that stays if only it is kept."""
    made_of = {"size": pa.int64(), "bands": pa.list_(pa.int64()), "sketch": pa.binary(), "fp": pa.int64()}

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            sets = (shingle_set(t, memo) for t in strings(batch.column("text")))
            made = [(len(s), buckets(s), odd_sketch(s), simhash.majority(s)) for s in sets]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(made_of.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "sha")), *columns], ["doc_id", "key", "sha", *made_of])

    rows = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("key"), F.unhex(F.sha2(normalised(), 256)).alias("sha"))
    made = rows.mapInArrow(run, "doc_id long, key binary, sha binary, size long, bands array<long>, sketch binary, fp long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    return cut(made.groupBy("sha").agg(first, *[F.first(c).alias(c) for c in made_of]).withColumn("node", F.monotonically_increasing_id()))


def alike(nodes: DataFrame) -> DataFrame:
    """a, b: candidates by SimHash. Of texts of one fingerprint each with the least; of fingerprints that link (a spanning forest of a
    dense group's links) their least texts."""
    of = cut(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("_n")))
    several = of.filter("_n > 1").withColumnRenamed("node", "a")
    same = lookup(nodes.select("fp", "node"), several, ["fp"], "_n", nodes.count()).filter("a < node").select("a", F.col("node").alias("b"))
    found = simhash.links(of.select("fp")).distinct()
    named = lambda fp, side: of.select(F.col("fp").alias(fp), F.col("node").alias(side))
    far = found.join(named("u", "x").hint("merge"), "u").join(named("v", "y").hint("merge"), "v")
    return same.unionByName(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may be similar enough by their odd sketches: texts are only looked at for these. None is lost."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, total: pa.Array) -> pa.Array:
        return pa.array([may_be(apart(x.as_py(), y.as_py()), n.as_py(), least) for x, y, n in zip(a, b, total)], pa.bool_())

    named = lambda side: nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.join(named("b").hint("merge"), "b").join(named("a").hint("merge"), "a")
    both = both.filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
    return both.filter(near("sketch_a", "sketch_b", F.col("size_a") + F.col("size_b"))).select("a", "b")


def compare(node: np.ndarray, size: np.ndarray, root: np.ndarray, sketches: list[bytes], least: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of members with different roots that may be similar enough: of each member `most`, those first that the most members may
    be similar to; and whether there are more."""
    near = np.zeros((len(node), len(node)), bool)
    width = np.array([len(s) for s in sketches])
    for w in np.unique(width):
        mine, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)  # sizes that may be similar are less than twice apart
        own = np.frombuffer(b"".join(sketches[i] for i in mine), np.uint64).reshape(len(mine), -1)
        folded = np.frombuffer(b"".join(sketches[i] for i in twice), np.uint64).reshape(len(twice), 2, own.shape[1])
        others, bits = np.concatenate([mine, twice]), np.concatenate([own, folded[:, 0] ^ folded[:, 1]])
        for i, x in enumerate(mine):
            differ = np.bitwise_count(bits ^ own[i]).sum(axis=1, dtype=np.int64)
            fit = np.minimum(size[x], size[others]) >= least * np.maximum(size[x], size[others])
            near[x, others] = fit & may_be(differ, size[x] + size[others], least)
    near |= near.T
    near &= root[:, None] != root[None, :]
    degree = near.sum(axis=0)
    if degree.max() <= most:
        x, y = np.nonzero(np.triu(near))
        return node[x], node[y], False
    order = np.argsort(-degree, kind="stable")
    ranked = near[:, order]
    x, y = np.nonzero(ranked & (np.cumsum(ranked, axis=1, dtype=np.int32) <= most))
    return node[x], node[order[y]], True


def meet(members: DataFrame, nodes: DataFrame, least: float, most: int) -> DataFrame:
    """a, b, more: what compare finds in each bucket of members (bucket, node, size, root, _n: the bucket's members).

    A bucket of over PART members is dealt out in parts, and each two parts are a group. All pairs of a bucket are compared: rows are
    its members, times the number of parts.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a group that may go on

        def found() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            if whole.num_rows > 1:
                a, b, more = compare(*(whole.column(c).to_numpy() for c in ("node", "size", "root")), whole.column("sketch").to_pylist(), least, most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([more] * len(a))], ["a", "b", "more"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            edges = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)] if len(key) else []
            for low, high in zip(edges, edges[1:]):
                if held and held[0].column("key")[0].as_py() != key[low]:
                    yield from found()
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from found()

    parts = F.ceil(F.col("_n") / PART).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
    dealt = dealt.select("bucket", "node", "size", "root", "parts", "part", F.explode(others).alias("other"))
    # two groups of one key would be compared with each other in vain, no more
    key = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))).alias("key")
    rows = dealt.select(key, "node", "size", "root").join(nodes.select("node", "sketch").hint("merge"), "node")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def settle(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their texts in held (node, text)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, first = Words(), None, None
        for batch in batches:
            use = []
            for x, one, other in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if x != last:
                    last, first = x, shingle_set(one.as_py(), memo)
                second = shingle_set(other.as_py(), memo)
                common = len(np.intersect1d(first, second, assume_unique=True))
                use.append(common / (len(first) + len(second) - common) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(use, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    # texts are not broadcast, whatever Spark thinks of their size; a text of very many pairs is a skewed key, which Spark splits
    named = lambda side: held.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(named("b").hint("merge"), "b").join(named("a").hint("merge"), "a")
    return both.select("a", F.col("a").alias("u"), F.col("b").alias("v"), "text_a", "text_b").mapInArrow(run, "u long, v long")


def unsettled(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int, int]:
    """bucket, node, size, root, _n: the members of buckets that hold texts of several components; how many pairs those make (0: none
    is left), and the most members of a bucket."""
    rooted = members.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
    several = cut(parts.agg(F.sum("c").alias("_n"), (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("pairs")).filter("pairs > 0"))
    left, rows, most = several.agg(F.sum("pairs"), F.sum("_n"), F.max("_n")).first()
    if not left:
        return members, 0, 0
    return cut(fitted(lookup(rooted, several.select("bucket", "_n"), ["bucket"], "_n", rows), rows)), left, most


def led(members: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """a, b: of each bucket's slots the least member, with all other members of the bucket; and the members but those that led."""
    # found by a combined aggregate, so that no task gets all of a bucket
    firsts = members.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot")).agg(F.min(F.struct("node", "root")).alias("f"), F.count(F.lit(1)).alias("c"))
    lead = firsts.groupBy("bucket").agg(F.collect_list("f").alias("leaders"), F.sum("c").alias("_n"))
    near = cut(lookup(members.drop("_n"), lead, ["bucket"], "_n", members.count()))
    met = near.select("node", "root", F.explode("leaders").alias("f")).filter("root <> f.root")
    rest = near.filter(~F.exists("leaders", lambda f: f["node"] == F.col("node"))).select("bucket", "node", "size")
    return met.select(F.least("f.node", "node").alias("a"), F.greatest("f.node", "node").alias("b")).distinct(), rest


def similar_roots(docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """node, root: for each node with a link the least of its component."""
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = cut(members.join(full.select("bucket"), "bucket", "left_semi").withColumn("root", F.col("node")))
    pairs = cut(alike(nodes))
    folder = shared_dir(docs.sparkSession, "similar")
    asked = members.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = cut(nodes.join(asked, "node", "left_semi").select("node", "sha", "size", "sketch"))
    # copies collapse before they are shuffled, so a text of very many rows is one a task
    once = docs.select("text", F.unhex(F.sha2(normalised(), 256)).alias("sha")).groupBy("sha").agg(F.first("text").alias("text"))
    once.join(wanted.select("node", "sha"), "sha").select("node", "text").write.parquet(folder)
    held = docs.sparkSession.read.schema("node long, text string").parquet(folder)
    joined = lambda roots, found: found if roots is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)
    roots, slots, before = None, 1, None
    while True:
        met, members = led(members, slots)
        met = met if roots is not None else met.unionByName(pairs).distinct()
        found = cut(settle(likely(met, wanted, least), held, least))
        roots = cut(components(joined(roots, found)))  # the stars so far stand for the links that made them
        members, left, most = unsettled(members, roots)
        if not left:
            return roots
        if most <= LARGE or before is not None and left > before / 2:
            break
        slots, before = 2 * slots, left
    most = FEW
    while True:
        pairs = cut(meet(members, wanted, least, most))
        found = cut(settle(pairs.select("a", "b"), held, least))
        if found.head(1):
            roots = cut(components(joined(roots, found)))
        if not pairs.filter("more").head(1):
            return roots
        members, left, _ = unsettled(members.select("bucket", "node", "size"), roots)
        if not left:
            return roots
        most *= MORE


def drop_similar(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that stay, all columns: of each component of similar texts exactly one, with the least doc_id that is not null.

    Texts without words are alike; rows go by id and text, so that null and repeated ids of different texts are kept apart.
    """
    nodes = texts(docs)
    rooted = nodes.join(similar_roots(docs, nodes, least), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return keep_rows(docs, rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key"))
