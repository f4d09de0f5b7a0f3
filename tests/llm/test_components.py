import random

import pytest

from folioforge.llm import common, components


@pytest.fixture
def wide(spark):
    """Many shuffle partitions that nothing puts together, as where tables are large."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            low, high = sorted((find(u), find(v)))
            root[high] = low
    return {x: find(x) for x in root}


def found(spark, edges):
    rows = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


def shapes(r):
    chain = [(i, i + 1) for i in range(-5, 30)]
    ring = [(100 + i, 100 + (i + 1) % 17) for i in range(17)]
    hub = [(200, 201 + i) for i in range(60)] + [(900, 201 + i) for i in range(0, 60, 2)]
    tree = [(1000 + i, 1000 + (i - 1) // 2) for i in range(1, 50)]
    some = [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)]
    edges = chain + ring + hub + tree + some + [(7, 7), (5000, 5000)]
    edges += [(v, u) for u, v in edges[::3]]
    r.shuffle(edges)
    return edges


@pytest.mark.parametrize("full", [1 << 12, 50])
def test_components_equal_the_plain_ones(wide, monkeypatch, full):
    monkeypatch.setattr(common, "FULL", full)  # in one task, and in several
    edges = shapes(random.Random(3))
    assert found(wide, edges) == plain(edges)
    assert found(wide, [(4, 4)]) == {} == found(wide, edges[:0])


def test_stars_need_no_round(wide, monkeypatch):
    rounds, star = [], components.star
    monkeypatch.setattr(components, "star", lambda *a: rounds.append(a) or star(*a))
    stars = [(10 * k + i, 10 * k) for k in range(20) for i in range(1, 9)]
    assert found(wide, stars) == plain(stars) and not rounds
    assert found(wide, [*stars, (15, 27)]) == plain([*stars, (15, 27)]) and rounds


def test_tasks_go_by_rows_not_by_shuffle_partitions(wide):
    """A task for each of hundreds of shuffle partitions in each stage of each round left more on disk than the links themselves."""
    edges, context = shapes(random.Random(5)), wide.sparkContext
    context.setJobGroup("components", "components")
    try:
        out = components.components(wide.createDataFrame(edges, "u long, v long"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numTasks for x in map(tracker.getStageInfo, stages) if x and x.numCompletedTasks)
    assert 0 < tasks < 600, tasks
    assert out.rdd.getNumPartitions() <= 2
