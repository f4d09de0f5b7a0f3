"""The fold of a group's survivor against a plain fold, and splits against plain counts."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest

from folioforge.operators import splits
from folioforge.operators import survivors as V


def plain_fold(rows):
    """rows: (id, place, date, seen, url, pages) in order."""
    held = None
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if held is None:
            held = r
            continue
        key = lambda x: (x[2], x[3] or datetime.datetime.min, x[4] or "")
        newer, older = (held, r) if key(held) >= key(r) else (r, held)
        held = older if (older[5] or 0) > 0 and (newer[5] or 0) < 0.5 * older[5] else newer
    return held[0], held[5] or 0


@pytest.mark.parametrize("size", [1, 3, 100_000])
def test_survivors_equal_a_plain_fold(spark, monkeypatch, size):
    monkeypatch.setattr(V, "RANGE", size)
    r = random.Random(size)
    groups = {f"g{n}": [] for n in range(50)} | {None: []}
    k = 0
    for n, name in enumerate(groups):
        for _ in range(n % 50 + 1):
            k += 1
            seen = r.choice([None, datetime.datetime(2021, 1, r.randint(1, 3), r.randint(0, 3))])
            groups[name].append((k, k, datetime.date(2020, 1, r.randint(1, 12)), seen, r.choice(["a", "b", None]) and f"u{r.randint(0, 5)}", r.choice([None, 0, 1, 2, 3, 5, 9, 20, 40])))
    table = spark.createDataFrame([(g, *x) for g, rows in groups.items() for x in rows], "grp string, id long, place long, date date, seen timestamp, url string, pages int").repartition(3)
    got = {x.grp: (x.survivor, x.pages) for x in V.group_survivors(table, "grp").collect()}
    assert got == {g: plain_fold(rows) for g, rows in groups.items()}
    assert V.group_survivors(table.limit(0), "grp").count() == 0


def plain_split(rows, labels, share):
    """One row at a time, as the draw is described; rows: sets of label numbers."""
    target = max(1, min(len(rows) - 1, round(len(rows) * share)))
    totals = Counter(x for s in rows for x in s)
    wanted = {x: int(np.rint(totals[x] * target / len(rows))) for x in range(labels)}
    held, open_rows = Counter(), list(rows)
    taken = 0
    while taken < target:
        left = Counter(x for s in open_rows for x in s)
        served = [x for x in range(labels) if wanted[x] - held[x] > 0 and left[x]]
        if not served:
            break
        label = min(served, key=lambda x: (left[x], held[x] - wanted[x], x))
        best = max((s for s in open_rows if label in s), key=lambda s: (sum(max(0, wanted[x] - held[x]) for x in s), len(s)))
        open_rows.remove(best)
        held.update(best)
        taken += 1
    return held, taken


@pytest.mark.parametrize("seed", range(4))
def test_shares_of_labels(spark, seed):
    r = random.Random(seed)
    rows = [tuple(x for x in range(6) if r.random() < (0.7, 0.4, 0.2, 0.1, 0.05, 0.02)[x]) for _ in range(400)]
    table = spark.createDataFrame([(k, [f"l{x}" for x in s] if s else None) for k, s in enumerate(rows)], "id int, labels array<string>")
    got = splits.multilabel_split(table, "id", "labels", 0.2).collect()
    assert len(got) == 400 and sum(x.held_out for x in got) == 80
    held = Counter(int(y[1]) for x in got if x.held_out for y in x.labels or [])
    plain, served = plain_split(rows, 6, 0.2)
    totals = Counter(x for s in rows for x in s)
    for label in range(6):
        want = np.rint(totals[label] * 0.2)
        # when no label is short any more the rest is drawn evenly, whatever labels it has
        assert min(plain[label], want) - 1 <= held[label] <= max(plain[label], want) + 80 - served + 1
    again = splits.multilabel_split(table.repartition(5), "id", "labels", 0.2).collect()
    assert {x.id for x in again if x.held_out} == {x.id for x in got if x.held_out}


def test_small_and_empty_splits(spark):
    table = spark.createDataFrame([(1, ["a"])], "id int, labels array<string>")
    assert [x.held_out for x in splits.multilabel_split(table, "id", "labels", 0.5).collect()] == [False]
    assert splits.multilabel_split(table.limit(0), "id", "labels", 0.5).count() == 0
