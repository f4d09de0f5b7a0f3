"""Fill-in-middle transformation by an Aho-Corasick event scan.

A text is read as units: a run of ASCII letters is one, any other character is one. One automaton finds the characters at which
the class changes (letter to other, other to letter) and the sentinels. Between two changes all characters are of one class, so
a gap's units follow by arithmetic: 1 for letters, its length for others. The running sums at these sparse events are the rank
index that turns a number of units into an offset.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, product
from string import ascii_letters

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import packed, quoted, strings, trimmed

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Characters whose events are held at once.
SEGMENT = 1 << 18
CHANGE, MARK = 0, 1


@dataclass(frozen=True)
class Settings:
    """`seed` starts the hashed string; of 100 texts `infilled` are transformed, of those `spm` of 100 with the suffix first."""

    seed: int = 1
    infilled: int = 90
    spm: int = 20


@cache
def events() -> ahocorasick.Automaton:
    """Finds each letter next to an other ASCII character, in both orders, and each sentinel."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    others = [c for c in map(chr, range(128)) if c not in ascii_letters]
    for a, b in chain(product(ascii_letters, others), product(others, ascii_letters)):
        found.add_word(a + b, CHANGE)
    for mark in MARKS:
        found.add_word(mark, MARK)
    found.make_automaton()
    return found


class Units:
    """The units of a text: their number, whether a sentinel is in it, and the offset at which so many units end.

    Runs of one class are kept for one segment at a time; of the others only the units before them."""

    def __init__(self, text: str) -> None:
        self.plain = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")  # one character for each
        self.marked, self.starts, self.before = False, list(range(0, len(text), SEGMENT)), [0]
        self.held = -1
        for k in range(len(self.starts)):
            self.before.append(self.before[-1] + self.load(k))
        self.n = self.before[-1]

    def load(self, k: int) -> int:
        """Reads segment k: `runs`, the starts of its runs, `letters`, and `sums`, the units up to each run's end."""
        if self.held != k:
            first = self.starts[k]
            last = min(first + SEGMENT, len(self.plain))
            found = np.fromiter(chain.from_iterable(events().iter(self.plain, max(0, first - 2), last)), np.int64).reshape(-1, 2)
            found = found[found[:, 0] >= first]
            self.marked |= bool((found[:, 1] == MARK).any())
            runs = found[found[:, 1] == CHANGE, 0]
            begins = len(runs) > 0 and runs[0] == first
            self.runs = runs if begins else np.concatenate([[first], runs])
            self.letters = (np.arange(len(self.runs)) % 2 == 0) == (self.plain[first] in ascii_letters)
            units = np.where(self.letters, 1, np.diff(self.runs, append=last))
            if self.letters[0] and first and not begins:  # the run and its unit began in the segment before
                units[0] = 0
            self.sums, self.held = units.cumsum(), k
        return int(self.sums[-1])

    def offset(self, rank: int) -> int:
        """The character after the first `rank` units."""
        if rank >= self.n:
            return len(self.plain)
        k = bisect_right(self.before, rank) - 1
        self.load(k)
        rank -= self.before[k]
        j = int(np.searchsorted(self.sums, rank, "right"))
        return int(self.runs[j]) if self.letters[j] else int(self.runs[j]) + rank - (int(self.sums[j - 1]) if j else 0)


def cut_up(text: str, digest: str, settings: Settings) -> tuple[int, str, int | None, int | None]:
    """n, form, and the characters of prefix and middle, from the first four groups of a hexadecimal digest."""
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    units = Units(text)
    if not text or units.marked or h3 % 100 >= settings.infilled:
        return units.n, "plain", None, None
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    first = units.offset(low)
    return units.n, "spm" if h4 % 100 < settings.spm else "psm", first, units.offset(high) - first


def assembled(text: Column, form: Column, prefix: Column, middle: Column) -> Column:
    """A text in its form; code points are counted."""
    a, b = F.substring(text, F.lit(1), prefix), F.substring(text, prefix + 1, middle)
    c = F.substring(text, prefix + middle + 1, F.char_length(text))
    psm, spm = F.concat(F.lit(PREFIX), a, F.lit(SUFFIX), c, F.lit(MIDDLE), b), F.concat(F.lit(SUFFIX), c, F.lit(PREFIX), a, F.lit(MIDDLE), b)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of, from the output and its form alone: no text that was cut has a sentinel of its own."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """row (all columns of docs), n, form (plain, psm or spm), prefix_chars, middle_chars and output; one row for each row of docs.

    A null text counts as empty; an empty text, and one with a sentinel in it, is plain. A null doc_id is hashed as an empty
    string. Repeated rows come out alike, an empty table gives none, and columns of docs clash with none of these, as they are in
    `row`. Narrow: no shuffle; a worker holds one Arrow batch and the events of SEGMENT characters.
    """

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long")
    def find(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        @trimmed
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, digests in batches:
                rows = [cut_up(t, h, settings) for t, h in zip(strings(texts), strings(digests))]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.StructArray.from_arrays(made, ["n", "form", "prefix_chars", "middle_chars"])

        return run(columns)

    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(quoted("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    rows = docs.select(packed(docs), F.coalesce(quoted("text"), F.lit("")).alias("text"), digest.alias("digest"))
    found = rows.select("row", "text", find("text", "digest").alias("f"))
    output = assembled(F.col("text"), F.col("f.form"), F.col("f.prefix_chars").cast("int"), F.col("f.middle_chars").cast("int"))
    return found.select("row", "f.n", "f.form", "f.prefix_chars", "f.middle_chars", output.alias("output"))


def digest(filled: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text restored from it."""
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return filled.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back)


SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), formed AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM formed
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM made
"""
