import itertools
import random

import corpus_pipeline
from folioforge.llm import similar


def shingles(text, words=5):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)} or {tuple(tokens)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def survivors(rows):
    """By all pairs: of each component the row with the least id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return sorted(min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values() if any(x[0] is not None for x in g))


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(6))


def edited(r, text, edits):
    tokens = text.split()
    for _ in range(edits):
        tokens[r.randrange(len(tokens))] = word(r)
    return " ".join(tokens)


def test_shingle_sets_equal_the_plain_ones():
    r = random.Random(2)
    memo = similar.Words()
    for n in [0, 1, 4, 5, 6, 50, 3000]:
        a = " ".join(r.choice("xyz") for _ in range(n))
        b = edited(r, a, 1) if n else a
        one, two = similar.shingle_set(a, memo), similar.shingle_set(b, memo)
        assert len(one) == len(shingles(a)) and len(set(one.tolist()) & set(two.tolist())) == len(shingles(a) & shingles(b))


def test_stage_drops_what_is_similar_by_all_pairs(spark, frame, tmp_path):
    r = random.Random(4)
    rows, seen = [], []
    for _ in range(30):
        base = " ".join(word(r) for _ in range(r.choice([60, 200, 400])))
        rows.append(base)
        for _ in range(r.choice([0, 1, 4])):
            text = edited(r, base, r.randint(1, max(1, len(base.split()) // 40)))
            seen.append(jaccard(shingles(base), shingles(text)))
            rows.append(text)
    chain = [" ".join(word(r) for _ in range(300))]  # each similar to the next only
    for _ in range(6):
        chain.append(edited(r, chain[-1], 5))
    rows += chain + ["", "one two", "One  two", "one three"]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert sum(0.8 <= x < 0.9 for x in seen) >= 10
    stays = corpus_pipeline.near(spark, frame(rows), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted((x.doc_id, x.text) for x in stays) == survivors(rows)


def test_large_group_and_null_ids(frame):
    r = random.Random(6)
    base = " ".join(word(r) for _ in range(200))
    rows = [(i, edited(r, base, r.randint(0, 9))) for i in range(50)]
    want = survivors(rows)
    assert 1 < len(want) < 40
    other = " ".join(word(r) for _ in range(80))
    nulls = [(None, other), (None, " ".join(word(r) for _ in range(80))), (3, edited(r, other, 1)), (None, None)]
    stays = [(x.doc_id, x.text) for x in similar.drop_similar(frame(rows + nulls)).collect()]
    assert sorted(x for x in stays if x[0] is not None) == sorted(want + [nulls[2]])
    assert sorted((x for x in stays if x[0] is None), key=repr) == sorted([nulls[1], nulls[3]], key=repr)
    assert similar.drop_similar(frame(rows).limit(0)).count() == 0


def family(r, members, words, edits):
    """Edited copies of one text, most of them similar to few others or none at 0.8."""
    base = " ".join(word(r) for _ in range(words))
    return [(i, edited(r, base, edits)) for i in range(members)]


def test_candidates_come_from_simhash(spark, frame):
    r = random.Random(8)
    rows = []
    for k in range(20):
        base = " ".join(word(r) for _ in range(400))
        rows += [(3 * k, base), (3 * k + 1, edited(r, base, 1)), (3 * k + 2, " ".join(word(r) for _ in range(300)))]
    nodes = similar.texts(frame(rows)).cache()
    fps = {x.node: x.fp & (2**64 - 1) for x in nodes.collect()}
    linked = {tuple(sorted(p)) for p in itertools.combinations(fps, 2) if (fps[p[0]] ^ fps[p[1]]).bit_count() <= 3}
    assert len(linked) >= 10 and {(x.a, x.b) for x in similar.alike(nodes).collect()} == linked


def test_odd_sketches_never_tell_more_than_sets_differ_in():
    r = random.Random(10)
    memo = similar.Words()
    for n in [0, 3, 40, 500, 520, 4000]:
        a = " ".join(r.choice("xyzuvw") * 3 for _ in range(n))
        for b in [a, edited(r, a, 3) if n else a, edited(r, a, n // 9) if n else a, a + " " + a, a[: len(a) // 4]]:
            one, two = (similar.shingle_set(x, memo) for x in (a, b))
            assert similar.apart(similar.odd_sketch(one), similar.odd_sketch(two)) <= len(set(one.tolist()) ^ set(two.tolist()))


def test_pairs_of_a_family_do_not_grow_with_its_square(frame, monkeypatch):
    looked, settle = [], similar.settle

    def counted(pairs, held, least):
        looked.append(pairs.count())
        return settle(pairs, held, least)

    monkeypatch.setattr(similar, "settle", counted)
    for name, value in {"PART": 40, "LARGE": 60, "FEW": 1, "MORE": 2}.items():  # parts of buckets, and rounds of both kinds
        monkeypatch.setattr(similar, name, value)
    rows = family(random.Random(12), 200, 250, 5)
    want = survivors(rows)
    assert len(want) > 20
    assert sorted((x.doc_id, x.text) for x in similar.drop_similar(frame(rows)).select("doc_id", "text").collect()) == want
    assert sum(looked) < 10 * len(rows)  # all pairs: 19900


def test_group_of_many_centres(frame, monkeypatch):
    """What is found in the first round by hubs leaves links for later rounds."""
    r = random.Random(14)
    base = " ".join(word(r) for _ in range(200))
    centres = [edited(r, base, 9) for _ in range(12)]
    rows = list(enumerate([edited(r, c, r.randint(0, 4)) for c in centres for _ in range(6)]))
    r.shuffle(rows)
    stays = similar.drop_similar(frame(rows)).select("doc_id", "text").collect()
    assert sorted((x.doc_id, x.text) for x in stays) == survivors(rows)
