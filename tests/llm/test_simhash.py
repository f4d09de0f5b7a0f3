import random

import numpy as np
import pytest
import xxhash

from folioforge.llm import simhash
from folioforge.llm.components import components


def brute(text, words=3):
    tokens = [w for w in (text or "").translate({**{i + 65: i + 97 for i in range(26)}, **{c: 32 for c in (9, 10, 11, 12, 13)}}).split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_the_plain_definition():
    r = random.Random(1)
    for text in [None, "", " \n", "One", "one Two", "É Ünder\x1cx\x85y A", *(" ".join(r.choice("ab cD éß") * r.randint(1, 4) for _ in range(r.randint(1, 60))) for _ in range(30))]:
        assert simhash.fingerprint(text, 3) % 2**64 == brute(text)


def test_every_word_within_one_bit_stands_at_the_home_anchor():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**32, 3000, dtype=np.uint64)
    y = x ^ np.where(r.random(3000) < 0.1, np.uint64(0), np.uint64(1) << r.integers(0, 32, 3000).astype(np.uint64))
    place, anchor, home = simhash.anchors(x)
    assert np.bitwise_count(anchor ^ x[place]).max() <= 2 and np.bitwise_count(anchor[home] ^ x[place[home]]).max() <= 1
    at_home = dict(zip(place[home].tolist(), anchor[home].tolist()))
    place, anchor, _ = simhash.anchors(y)
    came = {(p, a) for p, a in zip(place.tolist(), anchor.tolist())}
    assert all((i, at_home[i]) in came for i in range(3000))
    assert len(came) == len(place)


def linked(fps):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and root[j] > root[i]:
                    root[j], changed = root[i], True
    return root


@pytest.mark.parametrize("split", [simhash.SPLIT, 5])
def test_links_connect_what_brute_force_links(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = random.Random(3)
    fps = set()
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 5, 30])):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {0, 1, 2**63, 2**64 - 1}
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    root = linked(fps)
    found = {x["node"]: x["root"] for x in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    groups = {}
    for x, k in zip(signed, root):
        groups.setdefault(k, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_dense_anchor_is_compared_whole():
    r = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(base ^ (np.uint64(1) << r.integers(0, 64, 5000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 5000).astype(np.uint64)))
    assert len(fps) > 1500
    old, simhash.DENSE = simhash.DENSE, 64
    try:
        got = set()
        for x, y in simhash.compare(np.zeros(len(fps), np.int64), fps, np.ones(len(fps), bool), np.zeros(len(fps), bool)):
            got |= set(zip(x.tolist(), y.tolist()))
    finally:
        simhash.DENSE = old
    assert all((a ^ b).bit_count() <= 3 * 1000 for a, b in got)
    root = {x: x for x in fps.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    assert len({find(x) for x in root}) == 1


def test_near_duplicates_of_odd_rows(frame):
    docs = frame([(5, None), (3, ""), (9, "a b c d e f g"), (9, "a b c d e f g"), (2, "A b c D e f g"), (None, "z y x"), (7, "q w e r t y u i o p" * 3000)], extra="component_id")
    out = {(r.doc_id, r.fingerprint): (r.component_id, r.component_size) for r in simhash.find_near_duplicates(docs).collect()}
    assert out[5, "0" * 16] == (3, 2) and out[3, "0" * 16] == (3, 2)
    assert [v for k, v in out.items() if k[0] == 9] == [(2, 3)]
    assert [v for k, v in out.items() if k[0] is None] == [(None, 1)]
    assert sorted((r.doc_id for r in simhash.drop_near_duplicates(docs).collect()), key=repr) == [2, 3, 7, None]
    assert simhash.find_near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_stay_go_by_id_and_text(frame):
    r = random.Random(7)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    texts = [prose() for _ in range(6)]
    nulls = [(None, t) for t in texts[:4]] + [(None, texts[0].upper())]
    docs = frame([*nulls, (5, texts[4]), (5, texts[5]), (9, texts[4]), (9, texts[1]), (5, texts[4])])
    stays = [(x.doc_id, x.text) for x in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(t.lower() for _, t in stays) == sorted(texts)  # one row of each component
    assert {t.lower(): i for i, t in stays} == {texts[0]: None, texts[1]: 9, texts[2]: None, texts[3]: None, texts[4]: 5, texts[5]: 5}


def test_whole_query_equals_brute_force(frame):
    r = random.Random(9)
    prose = lambda n: [r.choice("abcdefghijklm") * r.randint(1, 3) for _ in range(n)]
    rows = []
    for _ in range(12):
        words = prose(r.choice([3, 40, 400]))
        for _ in range(r.randint(1, 6)):
            near = list(words)
            for _ in range(r.choice([0, 0, 1, 2])):
                near[r.randrange(len(near))] = "zz"
            rows.append((r.choice([None, *range(200)]), " ".join(near)))
    rows += [(500, None), (501, " "), (None, "")]
    fps = [brute(t) for _, t in rows]
    root = linked(fps)
    least = {}
    for k, (i, _) in zip(root, rows):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    wanted = sorted(((i, f"{f:016x}", least.get(k)) for (i, _), f, k in zip(rows, fps, root)), key=repr)
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in simhash.find_near_duplicates(frame(rows)).collect()), key=repr)
    assert got == wanted and len({x[2] for x in got}) < len(rows)
