"""Centroid clustering (k-means in integers) by kd-tree filtering.

Every task grows kd-trees over its own vectors, at most TREE to a tree; a node holds the count, the integer sum and the sum of
squares of its vectors and their box. They are written once. A round sends the few centroids down each tree: a centroid that is
strictly farther than another from every point of a node's box is dropped there; a node with one centroid left is taken whole,
by its sums; what reaches a leaf is resolved exactly. Vectors are never shuffled; a task adds up its trees, and the tasks'
sums, k x (dims + 2) numbers each, meet in one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import quoted, shared_dir, trimmed

LEAF, TREE = 32, 1 << 12
#: Largest integer component; beyond it an error is raised. Up to it a tree's sums of 64 squares fit a long.
LARGEST = 1 << 21
#: Numbers that a task holds at once when it compares nodes and centroids.
TOGETHER = 1 << 21
#: Integers below this are added exactly in double precision.
EXACT = 1 << 53
COUNT, INERTIA = -2, -1
FOREST = "ids array<long>, points binary, spans binary, children binary, lows binary, highs binary, sums binary, squares binary"


@dataclass
class Tree:
    """points in tree order; of each node, parents first: spans (start, end), children (the first of two that stand together, or -1),
    box, sum and sum of squares."""

    points: np.ndarray
    spans: np.ndarray
    children: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    NAMES = ("points", "spans", "children", "lows", "highs", "sums", "squares")

    @classmethod
    def grown(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """A tree over the rows of points, and their order in it. Halves at the median of the widest side; equal points are one leaf."""
        order, spans, children = np.arange(len(points)), [(0, len(points))], []
        for start, end in spans:  # grows on the way
            inside = points[order[start:end]]
            sides = inside.max(axis=0) - inside.min(axis=0)
            axis, half = int(sides.argmax()), (end - start) // 2
            if end - start <= LEAF or not sides[axis]:
                children.append(-1)
                continue
            order[start:end] = order[start:end][np.argpartition(inside[:, axis], half)]
            children.append(len(spans))
            spans += [(start, start + half), (start + half, end)]
        held = points[order]
        parts = [held[a:b] for a, b in spans]
        lows, highs, sums = (np.array([f(p) for p in parts]) for f in (lambda p: p.min(axis=0), lambda p: p.max(axis=0), lambda p: p.sum(axis=0)))
        return cls(held, np.array(spans), np.array(children), lows, highs, sums, np.array([(p * p).sum() for p in parts])), order

    def binaries(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, c), np.int64 if c in ("sums", "squares") else np.int32).tobytes() for c in self.NAMES]

    @classmethod
    def read(cls, row: dict[str, bytes], dims: int) -> Tree:
        shapes = {"children": (-1,), "squares": (-1,), "spans": (-1, 2)}
        kinds = {"sums": np.int64, "squares": np.int64}
        return cls(*[np.frombuffer(row[c], kinds.get(c, np.int32)).astype(np.int64).reshape(shapes.get(c, (-1, dims))) for c in cls.NAMES])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in integers: in double precision where that is exact."""
    small = a.shape[1] * max(1, np.abs(a).max(initial=0)) * max(1, np.abs(b).max(initial=0)) < EXACT
    return (a.astype(float) @ b.astype(float)).astype(np.int64) if small else a @ b


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * products(points, centroids.T) + (centroids * centroids).sum(axis=1)


FAR = np.iinfo(np.int64).max


def dominated(lows: np.ndarray, highs: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of each node and centroid: whether the node's centroid nearest to its middle is strictly nearer at every point of the box.

    |z - v|^2 - |c - v|^2 is linear in v, so its least value is at the corner of the box that lies farthest towards z."""
    best = np.where(alive, distances(lows + highs, 2 * centroids), FAR).argmin(axis=1)
    squares = (centroids * centroids).sum(axis=1)
    gap = centroids[None] - centroids[best][:, None]
    corner = np.maximum(gap * lows[:, None], gap * highs[:, None]).sum(axis=2)
    return squares[None] - squares[best][:, None] - 2 * corner > 0


def descend(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(node, centroid) for the nodes that are taken whole; the points of the other leaves; their centroids still in question."""
    _, first = np.unique(centroids, axis=0, return_index=True)  # of equal centroids the smallest number
    alive = np.zeros((1, len(centroids)), bool)
    alive[0, first] = True
    front, whole, open_points, open_alive = np.zeros(1, np.int64), [], [], []
    step = max(1, TOGETHER // centroids.size)
    while len(front):
        for at in range(0, len(front), step):
            some = slice(at, at + step)
            alive[some] &= ~dominated(tree.lows[front[some]], tree.highs[front[some]], alive[some], centroids)
        one = alive.sum(axis=1) == 1
        whole += zip(front[one].tolist(), alive[one].argmax(axis=1).tolist())
        leaf = ~one & (tree.children[front] < 0)
        for node, left in zip(front[leaf], alive[leaf]):
            places = np.arange(*tree.spans[node])
            open_points.append(places)
            open_alive.append(np.broadcast_to(left, (len(places), len(left))))
        split = ~one & ~leaf
        front = np.concatenate([tree.children[front[split]], tree.children[front[split]] + 1])
        alive = np.concatenate([alive[split], alive[split]])
    none = np.zeros((0, len(centroids)), bool)
    return whole, np.concatenate([np.zeros(0, np.int64), *open_points]), np.concatenate([none, *open_alive])


def resolved(points: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids in question, and its squared distance; ties go to the smaller number."""
    far = np.where(alive, distances(points, centroids), FAR)
    nearest = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
    return nearest, far[np.arange(len(far)), nearest]


def added(tree: Tree, centroids: np.ndarray, totals: np.ndarray) -> None:
    """Adds the tree to totals: of each centroid the count, the inertia and the sums."""
    whole, places, alive = descend(tree, centroids)
    for node, c in whole:
        n, sums = int(np.diff(tree.spans[node])[0]), tree.sums[node]
        totals[c, 0] += n
        totals[c, 1] += tree.squares[node] - 2 * (sums * centroids[c]).sum() + n * (centroids[c] * centroids[c]).sum()
        totals[c, 2:] += sums
    nearest, far = resolved(tree.points[places], alive, centroids)
    np.add.at(totals, (nearest, 0), 1)
    np.add.at(totals, (nearest, 1), far)
    np.add.at(totals[:, 2:], nearest, tree.points[places])


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and the squared distance of each point."""
    whole, places, alive = descend(tree, centroids)
    cluster, far = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64)
    for node, c in whole:
        cluster[slice(*tree.spans[node])] = c
    cluster[places] = resolved(tree.points[places], alive, centroids)[0]
    gap = tree.points - centroids[cluster]
    far[:] = (gap * gap).sum(axis=1)
    return cluster, far


def kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and point: the vectors with dims components, none null or non-finite, in integers floor(scale * x)."""
    e = quoted("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    point = F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return vectors.filter((F.size(e) == dims) & F.forall(e, finite)).select(quoted("vec_id").cast("long").alias("vec_id"), point.alias("point"))


def plant(points: DataFrame, dims: int) -> DataFrame:
    """The trees of all points, a row each, written to the shared folder."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: pa.Array, held: np.ndarray) -> pa.RecordBatch:
            tree, order = Tree.grown(held)
            found = ids.take(pa.array(order))
            columns = [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found), *[pa.array([b], pa.binary()) for b in tree.binaries()]]
            return pa.RecordBatch.from_arrays(columns, ["ids", *Tree.NAMES])

        ids, held = pa.array([], pa.int64()), np.zeros((0, dims), np.int64)
        for batch in batches:
            new = batch.column("point").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if new.size and (new.max() > LARGEST or new.min() < -LARGEST):
                raise ValueError(f"a component is beyond {LARGEST} after scaling; squared distances would not fit a long")
            ids, held = pa.concat_arrays([ids, batch.column("vec_id")]), np.concatenate([held, new])
            while len(held) >= TREE:
                yield row(ids[:TREE], held[:TREE])
                ids, held = ids[TREE:], held[TREE:]
        if len(held):
            yield row(ids, held)

    folder = shared_dir(points.sparkSession, "forest")
    points.mapInArrow(run, FOREST).write.parquet(folder)
    return points.sparkSession.read.schema(FOREST).parquet(folder)


def seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k points with the smallest SHA-256 of "seed:vec_id", those without an id last; ties by the points themselves."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r.point for r in points.orderBy(order, "point").limit(k).collect()], np.int64)


def summed(forest: DataFrame, centroids: np.ndarray) -> list[dict[int, int]]:
    """Of each centroid: its vectors' COUNT, INERTIA and, under 0, 1, ..., the sums of their components."""
    k, dims = centroids.shape
    grid = np.stack(np.meshgrid(np.arange(k), np.arange(COUNT, dims), indexing="ij"), axis=-1).reshape(-1, 2)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, most = np.zeros((k, dims + 2), np.int64), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(grid[:, 0], pa.int32()), pa.array(grid[:, 1], pa.int32()), pa.array(totals.ravel())], ["cluster", "what", "total"])
        for batch in batches:
            for at in range(batch.num_rows):
                tree = Tree.read({c: batch.column(c)[at].as_buffer() for c in Tree.NAMES}, dims)
                largest = max(int(np.abs(x).max()) for x in (tree.lows[0], tree.highs[0], centroids))
                new = len(tree.points) * dims * (2 * largest) ** 2
                if most + new >= 1 << 63:  # so much inertia might not fit: begin anew
                    yield out()
                    totals, most = np.zeros((k, dims + 2), np.int64), 0
                most += new
                added(tree, centroids, totals)
        yield out()

    parts = forest.select(*Tree.NAMES).mapInArrow(run, "cluster int, what int, total long")
    found: list[dict[int, int]] = [{COUNT: 0, INERTIA: 0} for _ in range(k)]
    for r in parts.groupBy("cluster", "what").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        found[r.cluster][r.what] = int(r.total)
    return found


def moved(centroids: np.ndarray, sums: list[dict[int, int]]) -> np.ndarray:
    """Every centroid that has vectors at floor(sum / count), exactly; the others where they are."""
    rows = [[s[d] // s[COUNT] for d in range(len(c))] if s[COUNT] else c.tolist() for c, s in zip(centroids, sums)]
    return np.array(rows, np.int64)


def assign(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    dims = centroids.shape[1]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cluster, far = assigned(Tree.read({c: batch.column(c)[at].as_buffer() for c in Tree.NAMES}, dims), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its integers): one row for each vector that is kept.

    A vector is kept if it has dims components, none null or non-finite; a null embedding is not. Null ids are kept, and are first
    centroids only where there are too few others. Repeated rows count each. Fewer than k vectors give so many centroids, and an
    empty table, or one with none to keep, gives no rows. Other columns are not read. A component beyond LARGEST is an error.
    Only centroids and their sums, k rows, come to the driver.
    """
    points = kept(vectors, dims, scale)
    forest, centroids = plant(points, dims), seeds(points, k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, summed(forest, centroids))
    last = summed(forest, centroids) if len(centroids) else []
    total = sum(s[INERTIA] for s in last)
    rows = [(c, s[INERTIA], total, p.tolist()) for c, (s, p) in enumerate(zip(last, centroids))]
    names = forest.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assign(forest, centroids).join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clustered: DataFrame) -> DataFrame:
    sha: Column = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))



def sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    order = f"sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, p"
    ctes = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS c, p FROM kept QUALIFY row_number() OVER (ORDER BY {order}) <= {k})",
    ]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (
  SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(kept.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c.c}}) AS m
  FROM kept CROSS JOIN c{t} AS c GROUP BY r
)""")
        if t < rounds:
            ctes.append(f"""s{t} AS (
  SELECT m.c AS c, i, sum(v) AS s, count(*) AS n FROM (SELECT m, unnest(p) AS v, unnest(range({dims})) AS i FROM a{t} JOIN kept USING (r)) GROUP BY ALL
), n{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM s{t} GROUP BY c
), c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(n{t}.p, c{t}.p) AS p FROM c{t} LEFT JOIN n{t} USING (c))""")
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.p, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = m.c
"""
