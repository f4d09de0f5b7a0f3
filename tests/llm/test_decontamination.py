import hashlib
import random
import re
from collections import Counter

import pytest

from folioforge.llm import decontamination as leaks

FOLD = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def cases():
    r = random.Random(5)
    vocabulary = ["the", "of", "été", "日本", "x9", "a", "ß", "q"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randint(4, 30))) for k in range(30)] + [(100, "one TWO"), (101, "one"), (10, "seven eight"), (9, "seven eight"), (None, "no id"), (102, None), (103, "..."), (3, "other text under a known id here")]
    long = " ".join(f"w{k}" for k in range(40))
    items += [(200, long), (201, long + " tail")]
    rows = [(k, text(r.randint(0, 120))) for k in range(120)] + [(k + 500, f"{text(5)}, {items[k % 30][1].upper()}! {text(9)}") for k in range(40)]
    rows += [(900, None), (901, ""), (902, " ,.\x00\x7f"), (903, "One,\n\nTWO--one"), (904, "k İ One"), (None, "seven.eight NO ID"), (905, long), (905, long), (906, "w5 w6 " + long[3:60]), (907, (long + " ") * 200)]
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "b") for i, t in items], "item_id long, text string, row string")


@pytest.mark.parametrize("block", [1 << 16, 100, 7])
def test_equals_brute_force_with_one_and_many_automata(spark, frame, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK", block)
    rows, items = cases()
    if block == 7:
        items = items[-12:-2]
    found = leaks.find_contamination(frame(rows, extra="n_hit"), benchmark(spark, items))
    assert Counter(tuple(x) for x in leaks.digest(found).collect()) == brute(rows, items)
    kept = leaks.drop_contaminated(frame(rows, extra="n_hit"), benchmark(spark, items))
    assert kept.columns == ["doc_id", "text", "n_hit"] and Counter(x.doc_id for x in kept.collect()) == Counter(x[0] for x in brute(rows, items).elements() if not x[5])
    for x in found.collect():  # the places are those of the text as written
        w = words_of(x.row.text)
        assert [words_of(x.row.text[r.start : r.end]) for r in x.runs] == [w[r.first : r.last + 1] for r in x.runs] and sum(r.last - r.first + 1 for r in x.runs) == x.n_hit
        assert all(a.last + 1 < b.first for a, b in zip(x.runs, x.runs[1:]))


def test_other_window_sizes(spark, frame):
    rows, items = cases()
    assert Counter(tuple(x) for x in leaks.digest(leaks.find_contamination(frame(rows), benchmark(spark, items), 3)).collect()) == brute(rows, items, 3)


def test_empty_tables(spark, frame):
    assert leaks.find_contamination(frame([]), benchmark(spark, [(1, "a b")])).collect() == []
    none = leaks.digest(leaks.find_contamination(frame([(1, "a b"), (2, None)]), benchmark(spark, []))).collect()
    assert sorted(map(tuple, none)) == sorted(brute([(1, "a b"), (2, None)], []).elements())


def test_matches_that_reach_over_earlier_runs():
    scanner = leaks.Scanner({"c": ["1"], "e": ["2"], "a b c d e f": ["3"], "g": ["4"]})
    n, runs, items = scanner.scan("x a B c d E f g y c")
    assert n == 10 and [(r.first, r.last) for r in runs] == [(1, 7), (9, 9)] and items == {"1", "2", "3", "4"}
