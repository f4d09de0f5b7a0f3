import hashlib
import random
import string

import pytest

from folioforge.llm import common, exact_dedup


def brute(rows):
    fold = {i: i + 32 for i in range(65, 91)}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(fold), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = max(known) if known else None, True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and left
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("share", [3, 20, 1000])  # with few hot keys, and with all that repeat
def test_equals_brute_force_with_small_blocks(frame, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4)
    monkeypatch.setattr(common, "HOT_SHARE", share)
    r = random.Random(2)
    texts = ["".join(r.choice("abAÉ\n") for _ in range(r.randint(0, 9))) for _ in range(60)] + ["x" * 40, "X" * 40, "x" * 41, "É" * 33, None, "", None]
    rows = [(r.choice([None, *range(80)]), r.choice(texts)) for _ in range(200)]
    rows += [(i, "hot" * 9) for i in range(1000, 1100)] + [(7, "hot" * 9)] * 3
    assert order(exact_dedup.find_duplicates(frame(rows, extra="key")).collect()) == order(brute(rows))
    kept = exact_dedup.drop_duplicates(frame(rows, extra="keep_id"))
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted((x[0] for x in brute(rows) if x[3]), key=repr)


def test_empty_table_and_long_text(frame):
    assert exact_dedup.find_duplicates(frame([])).count() == 0
    long = "".join(random.Random(1).choice(string.ascii_letters) for _ in range(100_000))
    out = exact_dedup.find_duplicates(frame([(1, long), (2, long.swapcase()), (3, long[:-1] + "!")])).collect()
    assert sorted((x.doc_id, x.keep_id, x.kept) for x in out) == [(1, 2, False), (2, 2, True), (3, 3, True)]
