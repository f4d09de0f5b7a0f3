import hashlib
import random
import re
from collections import Counter

import pytest

from folioforge.llm import fill_in_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(i, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text)


def texts():
    r = random.Random(3)
    pieces = ["word", "a", " ", "\n", "é", "日本", "😀", "?", "<P", ">", "<", "12", "\x00", "\t", "Zz", "S>", "ı", "K"]
    found = [None, "", " ", "a", "é", "<P>", "x<M>y", "<S", "<P<S<M", "A" * 999, "1" * 999, "a1" * 500, " \x85x"]
    found += ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(300)]
    return found + ["".join(r.choice("ab ") for _ in range(60_000)), "é" * 50_000]


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 1 << 18])
def test_equals_brute_force(frame, monkeypatch, segment):
    monkeypatch.setattr(fim, "SEGMENT", segment)
    r = random.Random(segment)
    for text in texts()[:-2] + [texts()[-2][:500]]:
        units = UNIT.findall(text or "")
        ranks, ends = fim.Units(text or ""), [0]
        for u in units:
            ends.append(ends[-1] + len(u))
        assert ranks.n == len(units) and ranks.marked == bool(re.search("<[PSM]>", text or ""))
        for rank in r.choices(range(len(ends)), k=20):
            assert ranks.offset(rank) == ends[rank]


def test_query_equals_brute_force_on_nulls_repeats_and_clashing_columns(frame):
    rows = list(enumerate(texts())) + [(None, "with no id"), (None, None), (5, "again"), (5, "again")]
    filled = fim.fill_in_middle(frame(rows, extra="output"))
    got = Counter(tuple(x) for x in fim.digest(filled).collect())
    assert got == Counter(brute(i, t) for i, t in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert filled.select("row.*").columns == ["doc_id", "text", "output"] and filled.filter("row.output <> 'x'").count() == 0
    assert fim.digest(fim.fill_in_middle(frame([]))).collect() == []


def test_settings_are_followed(frame):
    rows = [(i, f"some words {i}") for i in range(200)]
    forms = lambda s: Counter(x.form for x in fim.fill_in_middle(frame(rows), s).collect())
    assert forms(fim.Settings(infilled=100, spm=0)) == {"psm": 200} and forms(fim.Settings(infilled=0)) == {"plain": 200} and forms(fim.Settings(infilled=100, spm=100)) == {"spm": 200}
    assert forms(fim.Settings(seed=2)) != forms(fim.Settings())
