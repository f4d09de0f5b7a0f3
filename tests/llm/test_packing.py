import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioforge.llm import packing
from folioforge.llm.encoding import load

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def held(rows, pieces, window):
    """Each id in one piece, sequences without gaps, full or a power of two."""
    library = load(PATH)
    wanted = sorted((repr(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 and p.length > 0
        docs[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    got = []
    for (i, n), parts in docs.items():
        parts.sort(key=lambda p: (p.start, p.sequence_id))
        ids = b"".join(p.ids for p in parts)
        assert len(ids) % (4 * n) == 0
        got += [(repr(i), n)] * (len(ids) // (4 * n))
    assert sorted(got) == sorted((i, len(t)) for i, t in wanted)
    assert sum(p.length for p in pieces) == sum(len(t) for _, t in wanted)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0
    one = {i: t for i, t in wanted}
    for (i, _), parts in docs.items():
        if len(docs) == len(wanted):
            assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == list(one[repr(i)])


def test_pieces_cover_every_id_once(frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 300)
    rows = [(i, "word of the day " * (i % 7) + f"topic{i % 3} " * (i % 5)) for i in range(80)] + [(200, None), (201, ""), (None, "null id"), (300, "long text " * 700)]
    held(rows, packing.pack(frame(rows, extra="start"), PATH, 1, 64).collect(), 64)


def test_repeated_rows_and_empty_table(frame):
    rows = [(1, "same text"), (1, "same text"), (2, "same text")]
    pieces = packing.pack(frame(rows), PATH, 1).collect()
    held(rows, pieces, 2048)
    assert packing.pack(frame([]), PATH, 1).count() == 0
    digest = packing.digest(packing.pack(frame(rows), PATH, 1)).collect()
    assert {d.ids_crc32 for d in digest} <= {zlib.crc32(p.ids) for p in pieces}


def plain_scores(query, documents, corpus):
    """BM25 as it is written down, one document and term at a time."""
    out = []
    for d in documents:
        score, size = 0.0, len(d)
        for t in set(query.tolist()):
            tf, df = d.tolist().count(t), corpus.df[t]
            if tf and df > 1:
                idf = np.log(1 + (corpus.documents - df + 0.5) / (df + 0.5))
                score += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * size / corpus.mean))
        out.append(score)
    return out


def corpus_of(documents):
    df = np.zeros(200, np.int64)
    for d in documents:
        df[np.unique(d)] += 1
    return packing.Corpus(len(documents), sum(map(len, documents)) / len(documents), df)


def test_neighbours_equal_plain_scores():
    r = np.random.default_rng(2)
    for n in (1, 5, 60):
        everything = [r.integers(0, 200, r.integers(1, 90)).astype("<u4") for _ in range(3 * n)]
        corpus, shard = corpus_of(everything), everything[:n]
        index = packing.Index(shard, corpus)
        index.unused[r.integers(0, n, n // 3)] = False
        for query in everything[: n + 5]:
            wanted = plain_scores(query, shard, corpus)
            assert np.allclose(index.scores(query), wanted)
            got = index.neighbours(query)
            assert sorted(got) == np.flatnonzero(index.unused).tolist()
            assert (np.diff([wanted[k] for k in got]) <= 1e-9).all()


def test_counts_and_keys_cover_the_table(frame):
    rows = [(i, f"common word{i % 3} " * 3 + f"only{i}x") for i in range(40)]
    tokens, kind = packing.encoded(frame(rows).repartition(5), PATH, 1)
    corpus = packing.counted(tokens, kind)
    library = load(PATH)
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    assert corpus.documents == 40 and corpus.mean == sum(map(len, ids)) / 40
    assert all(corpus.df[t] == sum(t in d.tolist() for d in ids) for t in np.unique(np.concatenate(ids)))
    found = packing.keys(ids, corpus)
    assert len({tuple(k) for k in found}) < 40 and found.shape == (40, packing.TOP)
    for k, d in zip(found, ids):
        df = [corpus.df[t] for t in k if t >= 0]
        assert set(k) - {-1} <= set(d.tolist()) and df == sorted(df, reverse=True) and min(df) > 1


def test_like_documents_meet_from_all_over_the_table(frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 4000)
    import random

    r = random.Random(3)
    subject = [[f"{a}{b}" for b in "abcdefghij"] for a in ("stone", "river", "cloud", "glass", "paper", "horse", "green", "north")]
    rows = [(i, " ".join(r.choice(subject[i % 8]) for _ in range(60))) for i in range(400)]
    pieces = packing.pack(frame(rows).repartition(7), PATH, 1, 512).collect()
    held(rows, pieces, 512)
    together = defaultdict(set)
    for p in pieces:
        together[p.sequence_id].add(p.doc_id % 8)
    assert sum(len(x) == 1 for x in together.values()) > 0.7 * len(together)
