import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.errors import PythonException

from folioforge.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, tuple(math.floor(scale * x) for x in e)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda v: (v[0] is None, "" if v[0] is None else hashlib.sha256(f"1:{v[0]}".encode()).hexdigest(), v[1])
    centroids = [p for _, p in sorted(kept, key=key)[:k]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(near(p)[1], []).append(p)
        centroids = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *near(p)) for i, p in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last)


def vectors(dims, n, seed=1, spread=1.0):
    r = random.Random(seed)
    middles = [[r.uniform(-spread, spread) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + r.gauss(0, 0.1) for x in r.choice(middles)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).repartition(3)


def got(spark, rows, **how):
    return Counter(tuple(x) for x in clustering.digest(clustering.cluster(frame(spark, rows), **how)).collect())


@pytest.mark.parametrize("leaf, tree, together", [(1, 16, 1), (4, 50, 100), (32, 1 << 12, 1 << 21)])
def test_equals_brute_force(spark, monkeypatch, leaf, tree, together):
    for name, value in (("LEAF", leaf), ("TREE", tree), ("TOGETHER", together)):
        monkeypatch.setattr(clustering, name, value)
    rows = vectors(3, 300) + [(None, [0.5, 0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])] + [(1000 + i, [0.25, 0.25, -0.25]) for i in range(120)]
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 2.0]), (2004, [float("nan"), 1.0, 1.0]), (2005, [float("inf"), 1.0, 1.0]), (2006, [1e-320, -1e-320, -0.0])]
    assert got(spark, rows, dims=3) == brute(rows, 16, 3, 3)
    assert got(spark, rows, dims=3, k=4, rounds=6) == brute(rows, 4, 6, 3)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark, monkeypatch):
    monkeypatch.setattr(clustering, "LEAF", 1)
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]  # each point four times: first centroids repeat
    assert got(spark, rows, dims=2, scale=2) == brute(rows, 16, 3, 2, 2)


def test_few_and_no_vectors(spark):
    rows = vectors(64, 5)
    assert got(spark, rows) == brute(rows, 16, 3, 64)
    assert got(spark, [(None, [0.0] * 64)]) == brute([(None, [0.0] * 64)], 16, 3, 64)
    none = clustering.digest(clustering.cluster(frame(spark, [])))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.cluster(frame(spark, [(1, None), (2, [1.0])])).count() == 0


def test_large_components_are_exact_and_larger_ones_an_error(spark):
    rows = vectors(64, 200, spread=30000.0)
    assert got(spark, rows) == brute(rows, 16, 3, 64)
    with pytest.raises(PythonException, match="beyond"):
        clustering.cluster(frame(spark, [(1, [1e30] + [0.0] * 63)])).collect()


def test_nodes_are_pruned_and_taken_whole():
    points = np.array([[round(64 * x) for x in e] for _, e in vectors(3, 4000)], np.int64)
    tree, order = clustering.Tree.grown(points)
    assert sorted(order.tolist()) == list(range(4000)) and (tree.points == points[order]).all()
    whole, places, alive = clustering.descend(tree, points[:8])
    inside = sum(int(np.diff(tree.spans[n])[0]) for n, _ in whole)
    assert inside + len(places) == 4000 and inside > 1000 and alive.sum() < 8 * len(places)


def test_sql_equals_brute_force():
    rows = vectors(64, 300)
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    rows = [(i, np.array(e, np.float32).tolist()) for i, e in rows]
    db.executemany("INSERT INTO embeddings VALUES (?, ?, 1)", rows)
    assert Counter(tuple(x) for x in db.execute(clustering.sql()).fetchall()) == brute(rows, 16, 3, 64)
