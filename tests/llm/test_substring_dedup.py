import hashlib
import random

import numpy as np
import xxhash

from folioforge.llm import substring_dedup as S
from folioforge.llm.suffix_array import common_prefixes, suffix_array


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_suffix_array_and_common_prefixes_equal_sorting():
    r = np.random.default_rng(1)
    texts = [r.integers(1, size, n).tolist() for size, n in [(2, 1), (2, 30), (3, 50), (5, 300), (200, 500), (900, 1500), (3, 2000)] for _ in range(10)]
    texts += [[1] * 50, [1, 2] * 40, [2, 1] * 40, [1, 1, 2] * 30, [3, 2, 1] * 30, [5] * 700 + [3] * 700, list(range(400, 0, -1))]
    for text in texts:
        text = np.array([*text, 0])
        rows = text.tolist()
        array = suffix_array(text, int(text.max()) + 1)
        assert array.tolist() == sorted(range(len(rows)), key=lambda i: rows[i:])
        shared = common_prefixes(text, array)
        assert shared[array].tolist() == [0, *(common(rows[a:], rows[b:]) for a, b in zip(array, array[1:]))]


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (-(1 << 63) if rows[k][0] is None else rows[k][0], xxhash.xxh64_intdigest(texts[k], 42) % S.BUCKETS, texts[k], rows[k][0] is not None))
    seen, out = set(), []
    for k in order:
        data = (rows[k][1] or "").encode()
        mark, here = bytearray(len(data)), []
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = len([1 for i in range(len(data)) if mark[i] and (i == 0 or not mark[i - 1])])
        out.append((rows[k][0], len(data), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(data, mark) if not m)).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(15, 60)) for _ in range(6)] + ["z" * 150, "xy" * 90]
    rows = []
    for i in range(n):
        t = "".join(r.choice([text(r.randint(1, 30)), r.choice(passages), r.choice(passages)[r.randint(0, 40) :]]) for _ in range(r.randint(0, 5)))
        rows.append((r.choice([i, i, i, 7, None]), t))
    base = text(300)
    for i in range(30):
        j = r.randint(0, len(base) - 1)
        rows.append((1000 + i, base[:j] + "#" + base[j + 1 :]))
    rows += [(2000, base), (2001, base), (2001, base), (5, base), (3000, None), (3001, ""), (3002, "q" * 3000), (3003, "short")]
    return rows


def test_equals_brute_force(frame):
    rows = corpus(1)
    got = S.digest(S.remove_repeats(frame(rows, extra="rep"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_equals_brute_force_with_many_arrays_and_oversize_seeds(frame):
    rows = corpus(2, 60)
    got = S.digest(S.remove_repeats(frame(rows), array=2000, shard=1500)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_equals_brute_force_with_hot_seeds_and_little_memory(frame, monkeypatch):
    monkeypatch.setattr(S, "HOT_SHARE", 1 << 40)  # every seed over 1500 bytes is hot
    monkeypatch.setattr(S, "SEEDS", 50)
    monkeypatch.setattr(S, "SLICES", 3000)
    rows = corpus(3, 60) + [(-(1 << 63), corpus(2, 60)[-8][1]), (-(1 << 63), "w" * 300)]
    got = S.digest(S.remove_repeats(frame(rows), array=2000, shard=1500)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_an_id_of_very_many_rows_is_dealt_out(frame, monkeypatch):
    monkeypatch.setattr(S, "HOT_SHARE", 3)
    shared = "".join(random.Random(5).choice("abcdef ") for _ in range(400))
    rows = [(None, shared + f"{k}" * 60) for k in range(40)] + [(4, "x" + shared)]
    got = S.digest(S.remove_repeats(frame(rows))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_seeds_cover_each_string_once(monkeypatch):
    monkeypatch.setattr(S, "TOGETHER", 512)
    texts = [(t or "").encode() for _, t in corpus(4, 40)]
    starts = {}
    for h, i, first, last in S.seeds(texts):
        for k, a, b in zip(i.tolist(), first.tolist(), last.tolist()):
            starts.setdefault(k, []).extend(range(a, b + 1))
    for k, text in enumerate(texts):
        assert sorted(starts.get(k, [])) == list(range(max(0, len(text) - 99)))


def test_oversize_seed_gives_single_strings():
    shared = "".join(random.Random(3).choice("abcdef") for _ in range(110)).encode()
    rows = sorted((5, shared + bytes([65 + k]) * 10, k, 1, 0) for k in range(8))
    fold = S.Shard(most=300)
    out = [x for h, part, i, rep, a in rows for x in fold.take(h, part, (i, 0, rep), a)] + list(fold.close()) + list(fold.sort())
    assert all(s is not None for *_, s in out)
    assert len(out) == sum(len(p) - 99 for _, p, *_ in rows)


def test_empty_table(frame):
    assert S.remove_repeats(frame([])).count() == 0
