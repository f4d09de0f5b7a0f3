"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import quoted, strings, trimmed

SYMBOLS = str.maketrans("", "", "#*$%&|<>")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters hashed together.
TOGETHER = 500_000


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. `coverage`: most share of word characters inside n-grams found twice or more, for each n in words."""

    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.30, 8: 0.25, 12: 0.20})
    line_share: float = 0.50
    line_chars: float = 0.30
    symbols: float = 0.10
    least_words: int = 10
    base_window: int = 5
    base_percent: int = 20


def words_of(text: str) -> list[str]:
    """Runs without the six ASCII blanks."""
    return [w for w in text.translate(BLANKS).split(" ") if w]


def repeated_windows(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each position whether it lies in an n-window that its document has twice or more.

    ids: a number for each distinct word; doc: ascending. A window's rolling hash is the sum of its words' mixed ids times
    powers of an odd multiplier, by n vectorised steps; equal hashes are then held against the words themselves.
    """
    inside = np.zeros(len(ids), bool)
    if len(ids) < n:
        return inside
    last = len(ids) - n + 1
    hashed = doc[:last].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(n):
        hashed = hashed * MULTIPLIER + mixed[k : k + last]
    hashed ^= hashed >> np.uint64(29)
    starts = np.flatnonzero(doc[:last] == doc[n - 1 :])
    order = starts[np.argsort(hashed[starts], kind="stable")]
    same = hashed[order[1:]] == hashed[order[:-1]]
    at = np.flatnonzero(same)
    left, right = order[at], order[at + 1]
    true = doc[left] == doc[right]
    for k in range(n):
        true &= ids[left + k] == ids[right + k]
    if not true.all():  # a collision: name the windows exactly instead
        rows = np.stack([doc[starts], *[ids[starts + k] for k in range(n)]], axis=1)
        _, named, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = starts[counts[named.ravel()] > 1]
    else:
        found = np.concatenate([left, right])
    edge = np.zeros(len(ids) + 1, np.int64)
    found = np.unique(found)
    edge[found] += 1
    np.subtract.at(edge, found + n, 1)
    inside[:] = edge.cumsum()[:-1] > 0
    return inside


def measure(texts: list[str | None], rules: Rules) -> dict[str, np.ndarray]:
    """The counts and shares of each text."""
    names: dict[str, int] = {}
    ids, sizes, counts = [], [], np.zeros(len(texts), np.int64)
    symbols, dup_lines, lines, dup_line_chars = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, text in enumerate(texts):
        words = words_of(text) if text else []
        counts[i] = len(words)
        ids += [names.setdefault(w, len(names)) for w in words]
        sizes += map(len, words)
        if not text:
            continue
        symbols[i] = len(text) - len(text.translate(SYMBOLS))
        seen: set[str] = set()
        for line in text.split("\n"):
            if WORD.search(line):
                lines[i] += 1
                if line in seen:
                    dup_lines[i] += 1
                    dup_line_chars[i] += sum(map(len, words_of(line)))
                seen.add(line)
    doc, word, size = np.repeat(np.arange(len(texts)), counts), np.array(ids, np.int64), np.array(sizes, np.int64)
    chars = np.bincount(doc, size, len(texts)).astype(np.int64)
    out = {"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_lines": lines, "dup_line_chars": dup_line_chars}
    for n in sorted({rules.base_window, *rules.coverage}):
        inside = repeated_windows(word, doc, n)
        if n == rules.base_window:
            out["n_repeat_words"] = np.bincount(doc, inside, len(texts)).astype(np.int64)
        out[f"repeat_chars_{n}"] = np.bincount(doc, inside * size, len(texts)).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of each text."""
    base_failed = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.base_percent * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    bad = (m["n_symbols"] > rules.symbols * chars) | (m["n_dup_lines"] > rules.line_share * np.maximum(m["n_lines"], 1)) | (m["dup_line_chars"] > rules.line_chars * chars)
    for n, most in rules.coverage.items():
        bad |= m[f"repeat_chars_{n}"] > most * chars
    return base_failed, ~base_failed & ~bad


def parts(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text or "")
        if n >= TOGETHER:
            yield part
            part, n = [], 0
    if part:
        yield part


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, the shares' numerators, base_failed and kept, one row for each row of docs.

    A null or empty text has no words and fails the base rule. Repeated rows are judged alike; other columns are not read.
    Narrow: no shuffle, whole texts, TOGETHER characters at a time.
    """
    extra = ("n_lines", "dup_line_chars", *(f"repeat_chars_{n}" for n in sorted({rules.base_window, *rules.coverage})))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts(strings(batch.column("text"))):
                m = measure(part, rules)
                base, kept = verdict(m, rules)
                columns = [batch.column("doc_id").slice(at, len(part)), *[pa.array(m[c], pa.int64()) for c in REPORT], pa.array(base), pa.array(kept), *[pa.array(m[c], pa.int64()) for c in extra]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *REPORT, "base_failed", "kept", *extra])
                at += len(part)

    schema = ", ".join(["doc_id long", *[f"{c} long" for c in REPORT], "base_failed boolean", "kept boolean", *[f"{c} long" for c in extra]])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, all columns, whose text passes the rules; null texts do not."""

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        @trimmed
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array([bool(k) for part in parts(strings(column)) for k in verdict(measure(part, rules), rules)[1]], pa.bool_())

        return run(texts)

    return docs.filter(passes(quoted("text")))
