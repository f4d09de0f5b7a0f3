"""Chat formatting by event-sourced reconstruction.

A log has one event a row: conv_id, message (order of the message), seq, kind, role, text. Events are dealt out by conversation
and sorted by message and seq; so all events of a message stand together, and one pass folds them, one message held at a time:

    message     opens a message with role and text        delta       appends to its text (opens it if none is open)
    edit        replaces its text                         regenerate  empties it; later deltas fill it again
    delete      takes it away

Each final message is rendered as a segment of the conversation's text. Control strings inside texts are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template. In texts the first character of a control string becomes a code, so none is left; \ becomes \\.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYSTEM]", "[/SYSTEM]", "[ROLE=", "[/ROLE]")
CODES = {"<": "\\a", "[": "\\l", "]": "\\r", "\\": "\\\\"}
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("[SYSTEM] ", " [/SYSTEM]"), "assistant": (" ", "</s>")}
ESCAPED = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
CODED = re.compile(r"\\[alr\\]")
SEGMENT = re.compile(r"(<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]|\[SYSTEM\] (?P<system>.*?) \[/SYSTEM\]|\[ROLE=(?P<role>.*?)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>)", re.S)
SCHEMA = "conv_id long, position long, role string, segment string, loss_start long, loss_end long"
BATCH = 2_000_000


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: CODES[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    back = {v: k for k, v in CODES.items()}
    return CODED.sub(lambda m: back[m[0]], text)


def render(role: str, text: str, first: bool) -> tuple[str, int, int]:
    """A message's segment and, in it, the span that loss is taken on; empty but for assistant texts."""
    before, after = FRAMES.get(role) or (f"[ROLE={escape(role).replace(']', CODES[']'])}] ", " [/ROLE]")
    before, body = ("<s>" if first else "") + before, escape(text)
    return before + body + after, len(before), len(before) + len(body) * (role == "assistant")


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) messages of a formatted text, of one or more segments."""
    out, at = [], 0
    while at < len(text):
        if not (m := SEGMENT.match(text, at)):
            raise ValueError(f"no segment at {at}")
        role = next(r for r in ("user", "system", "assistant", "other") if m[r] is not None)
        out.append((unescape(m["role"]) if role == "other" else role, unescape(m[role])))
        at = m.end()
    return out


@dataclass
class Message:
    role: str
    parts: list[str]


class Fold:
    """Final messages of a stream of events in order; (conv_id, number of the message, role, text) once a message is over."""

    def __init__(self):
        self.key = self.now = None
        self.conv, self.count = object(), 0

    def end(self) -> Iterator[tuple[int | None, int, str, str]]:
        if self.now:
            yield self.conv, self.count, self.now.role, "".join(self.now.parts)
            self.count += 1
        self.now = None

    def take(self, conv: int | None, message: int | None, kind: str | None, role: str | None, text: str | None) -> Iterator[tuple[int | None, int, str, str]]:
        if (conv, message) != self.key or kind == "message":
            yield from self.end()
            if conv != self.conv:
                self.conv, self.count = conv, 0
            self.key = (conv, message)
        text = text or ""
        if kind == "message" or (kind in ("delta", "edit") and not self.now):
            self.now = Message(role or "", [text])
        elif self.now and kind == "delta":
            self.now.parts.append(text)
        elif self.now and kind in ("edit", "regenerate"):
            self.now.parts = [text] if kind == "edit" else []
        elif kind == "delete":
            self.now = None


def format_chats(events: DataFrame) -> DataFrame:
    """The segments of all conversations: conv_id, position, role, segment, loss_start, loss_end (in the segment, end excluded).

    A conversation's text is its segments joined in order of position. Null texts are empty, a null role is the empty role, null
    conversation ids form one conversation, null messages come first; events of equal order stand by kind, role and text. A
    deleted message gives no segment; an unknown kind does nothing. Rows of a partition stand in order, conversation by
    conversation. An empty log gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, held, size = Fold(), [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text"))):
                for out in fold.take(*row):
                    held.append(out)
                    size += len(out[3])
                if size > BATCH:
                    yield packed(held)
                    held, size = [], 0
        held += fold.end()
        if held:
            yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        made = [(conv, n, role, *render(role, text, n == 0)) for conv, n, role, text in rows]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["conv_id", "position", "role", "segment", "loss_start", "loss_end"])

    few = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    return few.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text").mapInArrow(run, SCHEMA)


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log."""
    return turns.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def digest_chats(segments: DataFrame, ordered: bool = True) -> DataFrame:
    """What format_chats wrote, read back: each conversation's turns, loss text and length.

    Takes the rows as format_chats leaves them, a conversation whole and in order. With `ordered` false, as after a write and a
    read, they are dealt out and sorted first; a conversation met out of order is a ValueError.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = conv = None
        for batch in batches:
            done = []
            for c, position, segment, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "segment", "loss_start", "loss_end"))):
                if now is None or c != conv:
                    if now is not None:
                        done.append(row(conv, now))
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if position != now[0]:
                    raise ValueError(f"conversation {c}: {position} where {now[0]} should stand; the rows are not in order")
                for role, text in parse(segment):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[low:high])
                now[2] += len(loss)
                now[3].update(loss.encode())
                now[4] += len(segment)
            yield batch_of(done)
        if now is not None:
            yield batch_of([row(conv, now)])

    def row(conv, now):
        return (conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))

    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant that both say control strings."""
    return spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
