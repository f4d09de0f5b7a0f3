import random
import zlib

import numpy as np

from folioforge.llm import language_id

WORDS = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "grüße über straße schön".split(), "zz": "kva okto nova zibo".split()}


def text(r, lang, n=40):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"], hidden=3)
    for name in ("W", "U", "V", "b"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y, w = r.integers(0, 257, (5, 6)), r.integers(0, 3, 5), np.ones((5, 6))
    _, grads = net.gradients(x, y, w)
    for p, g in zip((net.W, net.U, net.V, net.b), grads):
        flat = np.flatnonzero(np.abs(g.ravel()) > 1e-4)[:5]
        for i in flat:
            was, eps = p.ravel()[i], 1e-3
            p.ravel()[i] = was + eps
            up = net.gradients(x, y, w)[0]
            p.ravel()[i] = was - eps
            down = net.gradients(x, y, w)[0]
            p.ravel()[i] = was
            assert abs((up - down) / (2 * eps) - g.ravel()[i]) < 2e-3


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, text(r, lang), lang, "q") for i, lang in enumerate(r.choice(list(WORDS)) for _ in range(300))]
    odd = [(1000, None, "xx", "q"), (1001, "", "xx", "q"), (1002, " 12 !?", "yy", "q"), (None, text(r, "yy"), None, "q"), (1003, text(r, "zz", 20_000), None, "q"), (1003, text(r, "zz", 20_000), None, "q")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang, _ in rows}
    held = [(x.lang_pred == truth[x.doc_id]) for x in out if x.held_out and x.doc_id in truth]
    assert len(held) > 50 and sum(held) >= 0.98 * len(held)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out if x.doc_id is not None)
    assert {x.lang_pred for x in out if x.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {x.lang_pred for x in out if x.doc_id == 1003} == {"zz"} and all(0 <= x.score <= 1 for x in out)
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_a_rare_language_is_learned_from_a_bounded_sample(spark):
    r = random.Random(5)
    rows = [(i, text(r, "xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(1500)]
    rows += [(2000 + i, text(r, "zz"), "zz") for i in range(15)] + [(5000 + i, rows[1][1], "xx") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    windows = language_id.training_windows(docs, 300)
    assert len(windows) <= 3 * 300 and windows == language_id.training_windows(docs.repartition(3), 300)
    assert {label for _, label in windows} == set(WORDS)
    network = language_id.fit(docs, 300)
    out = {x.doc_id: x.lang_pred for x in language_id.identify(docs, network).collect() if x.held_out}
    assert all(out[i] == "zz" for i in out if 2000 <= i < 2015) and any(2000 <= i < 2015 for i in out)
    assert sum(out[i] == ("xx" if i % 2 else "yy") for i in out if i < 1500) >= 0.97 * sum(i < 1500 for i in out)


def test_quotas_share_out_what_rare_languages_leave():
    assert language_id.quotas({"a": 5, "b": 1000, "c": 1000}, 300) == {"a": 5, "b": 147, "c": 148}
    assert language_id.quotas({}, 10) == {} and language_id.quotas({"a": 3}, 10) == {"a": 3}
