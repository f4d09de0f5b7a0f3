import hashlib
import random

import pytest

from folioforge.llm import chat

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string, segment string"


def test_escape_round_trip():
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\a", "\\l", "[", "]", "<", " ", "x", "é", "\n", "/INST]"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        coded = chat.escape(text)
        assert chat.unescape(coded) == text and not any(c in coded for c in chat.CONTROL)
        roles = r.choice(["user", "system", "assistant", "", "to]ol", "a [/ROLE]"])
        segment, low, high = chat.render(roles, text, r.random() < 0.5)
        assert chat.parse(segment * 1) == [(roles, text)]
        assert chat.unescape(segment[low:high]) == (text if roles == "assistant" else "")


def test_fold_of_deltas_edits_regenerations_and_deletions(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 0, 9, "edit", None, "hello"),
        (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "wro"), (1, 1, 3, "delta", None, "ng"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "ri"), (1, 1, 6, "delta", None, "ght"), (1, 2, 7, "message", "user", "gone"), (1, 2, 8, "delete", None, None),
        (1, 3, 9, "delta", "assistant", "only a delta"), (2, None, None, "message", None, None), (None, 0, 0, "message", "user", "n"), (3, 0, 0, "strange", "user", "x"),
    ]
    random.Random(2).shuffle(log)
    rows = chat.format_chats(spark.createDataFrame([(*x, "x") for x in log], EVENTS)).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.conv_id or 0, r.position)):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.segment
    assert {k: chat.parse(v) for k, v in texts.items()} == {1: [("user", "hello"), ("assistant", "right"), ("assistant", "only a delta")], 2: [("", "")], None: [("user", "n")]}


def test_digest_equals_brute_force(spark):
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice([None, "", "a", "</s>[INST] é\\", "b\n" * 50])) for c in [1, 2, 3, 3, 9] for t in range(r.randint(1, 40))]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    frame = spark.createDataFrame([(*x, 1) for x in turns], "conv_id long, turn long, role string, text string, position int")
    got = {x.conv_id: x for x in chat.digest_chats(chat.format_chats(chat.turns_as_events(frame))).collect()}
    for conv in {x[0] for x in turns}:
        mine = sorted((x[1:] for x in turns if x[0] == conv), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or ""))
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text or ''}\n" for _, role, text in mine).encode()).hexdigest()
        loss = "".join(text or "" for _, role, text in mine if role == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_chats(chat.format_chats(chat.turns_as_events(frame.limit(0)))).count() == 0


def test_digest_of_rows_read_back_in_parts(spark):
    turns = [(c, t, "user" if t % 2 else "assistant", f"text {c} {t}") for c in range(20) for t in range(30)]
    segments = chat.format_chats(chat.turns_as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    whole = sorted(map(tuple, chat.digest_chats(segments).collect()))
    dealt = spark.createDataFrame(segments.collect(), segments.schema).repartition(7)
    assert sorted(map(tuple, chat.digest_chats(dealt, ordered=False).collect())) == whole
    with pytest.raises(Exception, match="not in order"):
        chat.digest_chats(dealt).collect()
