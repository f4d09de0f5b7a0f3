import random
import re

import numpy as np

from folioforge.llm import quality

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = BLANK.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_counts_equal_brute_force(frame):
    r = random.Random(1)
    texts = [None, "", " \n\t\x0b\x0c\r", "a\xa0b\x85c\x1cd # é", "word " * 9, "one two three four five " * 300, "a\n\na\nb\na \n" * 3, "x" * 50_000]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["\n".join(" ".join(r.choice("abcdefghij#") for _ in range(8)) for _ in range(r.randint(1, 30))) for _ in range(20)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]
    got = quality.quality_report(frame(rows, extra="kept")).collect()
    assert len(got) == len(rows)
    assert sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got), key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert not any(x.kept and x.base_failed for x in got)
    good = quality.keep_good(frame(rows, extra="kept"))
    assert good.columns == ["doc_id", "text", "kept"] and good.count() == sum(x.kept for x in got)
    assert quality.quality_report(frame([])).count() == 0 and quality.keep_good(frame([])).count() == 0


def test_colliding_hashes_are_settled_by_the_words(monkeypatch):
    monkeypatch.setattr(quality, "MULTIPLIER", np.uint64(1))  # then the order of words does not count
    ids = np.array([1, 2, 3, 4, 5, 5, 4, 3, 2, 1, 7, 1, 2, 3, 4, 5])
    assert quality.repeated_windows(ids, np.zeros(16, int), 5).tolist() == [True] * 5 + [False] * 6 + [True] * 5


def test_clean_text_is_kept(frame):
    r = random.Random(2)
    clean = "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(12)) for _ in range(40))
    assert [x.kept for x in quality.quality_report(frame([(1, clean), (2, clean + "\n" + clean)])).collect()] == [True, False]


def brute_shares(text, n):
    """Characters of words inside n-windows that are found twice or more, and of lines equal to an earlier one."""
    words = BLANK.findall(text or "")
    windows = {}
    for i in range(len(words) - n + 1):
        windows.setdefault(tuple(words[i : i + n]), []).append(i)
    inside = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(n)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if BLANK.search(line):
            lines += sum(map(len, BLANK.findall(line))) if line in seen else 0
            seen.add(line)
    return sum(len(words[i]) for i in inside), lines


def test_shares_and_verdict_equal_brute_force(frame):
    r = random.Random(3)
    part = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(4, 14)))
    texts = [None, ""]
    for _ in range(60):
        lines = [part() for _ in range(r.randint(1, 12))]
        texts.append("\n".join(r.choice(lines) if r.random() < 0.3 else part() for _ in range(r.randint(1, 25))))
    rules, rows = quality.Rules(), list(enumerate(texts))
    verdicts = set()
    for x in quality.quality_report(frame(rows)).collect():
        text = texts[x.doc_id]
        n, chars, symbols, dup, _, failed = brute(text)
        for k in (5, 8, 12):
            assert (x[f"repeat_chars_{k}"], x.dup_line_chars) == brute_shares(text, k)
        lines = sum(bool(BLANK.search(y)) for y in (text or "").split("\n"))
        bad = symbols > rules.symbols * chars or dup > rules.line_share * max(1, lines) or x.dup_line_chars > rules.line_chars * chars or any(brute_shares(text, k)[0] > most * chars for k, most in rules.coverage.items())
        assert x.kept == (not failed and not bad) and x.n_lines == lines
        verdicts.add(x.kept)
    assert verdicts == {True, False}
