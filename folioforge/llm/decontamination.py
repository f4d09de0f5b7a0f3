"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of digits, lower-cased ASCII letters and characters beyond ASCII. A window is `size` words in a row of an item; an
item of fewer words is one window. Each word of the windows gets a character of its own, so that a window is a short string and
a text, with one character for each of its words, is scanned once. Matches are runs of words; the words' offsets in the text as
it was written are looked up where there are matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower, cut, packed, quoted, shared_dir, strings, trimmed

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(PATTERN)
#: Windows of one automaton, which bounds what is collected and broadcast, and the words' characters, 10 a window, to Unicode's.
BLOCK = 1 << 16
UNKNOWN = "\0"
FOUND = "n_words long, n_hit long, runs array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def folded(text: str) -> str:
    """A-Z alone in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """window (words joined by blanks) and item, each pair once."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(quoted("text"), F.lit(""))), F.lit(PATTERN), F.lit(0))
    rows = benchmark.select(F.coalesce(quoted("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))))
    return starts.select(F.concat_ws(" ", F.slice("words", F.col("at"), F.lit(size))).alias("window"), "item").distinct()


@dataclass
class Run:
    """Words first to last, all inside matches."""

    first: int
    last: int


class Scanner:
    """The automaton of some windows, each with the items that have it."""

    def __init__(self, windows: dict[str, list[str]]) -> None:
        self.letters: dict[str, str] = {}
        self.found = ahocorasick.Automaton()
        for window, items in windows.items():
            words = window.split(" ")
            key = "".join([self.letters.setdefault(w, chr(len(self.letters) + 1)) for w in words])
            self.found.add_word(key, (len(words), tuple(items)))
        if windows:
            self.found.make_automaton()

    def scan(self, text: str) -> tuple[int, list[Run], set[str]]:
        """The number of words, the runs of hit words in order, none touching another, and the items with a window in the text."""
        words = WORD.findall(folded(text))
        runs: list[Run] = []
        seen: set[tuple[str, ...]] = set()
        if self.letters:
            letter = self.letters.get
            for last, (size, items) in self.found.iter("".join([letter(w, UNKNOWN) for w in words])):
                first = last - size + 1
                while runs and runs[-1].last >= first - 1:  # matches come by their ends, so what they meet is at the end
                    first = min(first, runs.pop().first)
                runs.append(Run(first, last))
                seen.add(items)
        return len(words), runs, {i for items in seen for i in items}


def offsets(text: str, runs: list[Run]) -> Iterator[tuple[int, int, int, int]]:
    """Each run's words and its place in the text as written: the first character, and the one after the last."""
    left = iter(runs)
    run = next(left, None)
    start = 0
    for k, word in enumerate(WORD.finditer(folded(text))) if run else ():
        if k == run.first:
            start = word.start()
        if k == run.last:
            yield run.first, run.last, start, word.end()
            run = next(left, None)
            if run is None:
                return


def scanned(column: Column, windows: dict[str, list[str]], docs: DataFrame) -> Column:
    """FOUND of each text."""
    held = docs.sparkSession.sparkContext.broadcast(windows)

    @F.arrow_udf(FOUND)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        @trimmed
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scanner = Scanner(held.value)
            for texts in batches:
                yield column_of(found_in(scanner, t or "") for t in strings(texts))

        return run(columns)

    return scan(column)


def found_in(scanner: Scanner, text: str) -> dict:
    n, runs, items = scanner.scan(text)
    hits = [dict(zip(("first", "last", "start", "end"), x)) for x in offsets(text, runs)]
    return {"n_words": n, "n_hit": sum(r.last - r.first + 1 for r in runs), "runs": hits, "items": sorted(items)}


RUN_TYPE = pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")])
FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("runs", pa.list_(RUN_TYPE)), ("items", pa.list_(pa.string()))])


def column_of(rows: Iterable[dict]) -> pa.Array:
    return pa.array(rows, FOUND_TYPE)


def merged(found: list[dict]) -> dict:
    """Runs and items of what several automata found in one text, as one would have found them."""
    runs: list[dict] = []
    for r in sorted((r for f in found for r in f["runs"]), key=lambda r: (r["first"], r["last"])):
        if runs and r["first"] <= runs[-1]["last"] + 1:
            if r["last"] > runs[-1]["last"]:
                runs[-1] |= {"last": r["last"], "end": r["end"]}
        else:
            runs.append(dict(r))
    return {"n_hit": sum(r["last"] - r["first"] + 1 for r in runs), "runs": runs, "items": sorted({i for f in found for i in f["items"]})}


def joined(n_words: Column, parts: Column) -> Column:
    """FOUND, from the number of words and a list of what each automaton FOUND."""

    @F.arrow_udf(FOUND)
    def run(sizes: pa.Array, lists: pa.Array) -> pa.Array:
        return column_of({"n_words": n, **merged(f or [])} for n, f in zip(sizes.to_pylist(), lists.to_pylist()))

    return run(n_words, parts)


def block_windows(windows: DataFrame, blocks: int, block: int) -> dict[str, list[str]]:
    """The windows of one block and their items. A hash of both deals them out, so a block has BLOCK pairs, give or take their scatter."""
    some = windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
    found: dict[str, list[str]] = {}
    for r in some.collect():
        found.setdefault(r.window, []).append(r.item)
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """row (all columns of docs), n_words, n_hit, runs (of hit words: numbers of the first and last word, characters from start up
    to end of the text as written) and items (ids in string order, each once); one row for each row of docs.

    A null or empty text has no words; an item without words has no window, one without an id is the item "". Items that repeat
    an id count once, rows that repeat come out alike. Empty tables give no rows, or no hits. Columns of docs clash with none of
    these, as they are in `row`. Narrow: no shuffle of docs while the benchmark has at most BLOCK windows. More of them are dealt
    out to blocks of that size; each is an automaton and a pass of its own, only the texts with hits, each text once, are written,
    and joined to the rows by the SHA-256 of the folded text.
    """
    windows = cut(item_windows(benchmark, size))
    blocks = max(1, -(-windows.count() // BLOCK))
    rows = docs.select(packed(docs), quoted("text").alias("text"))
    first = rows.select("row", "text", scanned(F.col("text"), block_windows(windows, blocks, 0), docs).alias("f"))
    if blocks == 1:
        return first.select("row", "f.*")
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    folder = shared_dir(docs.sparkSession, "leaks")
    for block in range(blocks):
        found = rows.select(sha.alias("sha"), scanned(F.col("text"), block_windows(windows, blocks, block), docs).alias("f"))
        found.filter("f.n_hit > 0").groupBy("sha").agg(F.first("f").alias("f")).write.parquet(f"{folder}/{block}")
    parts = docs.sparkSession.read.parquet(*[f"{folder}/{b}" for b in range(blocks)]).groupBy("sha").agg(F.collect_list("f").alias("parts"))
    counted = first.select("row", F.col("f.n_words").alias("n_words"), sha.alias("sha"))
    return counted.join(parts, "sha", "left").select("row", joined(F.col("n_words"), F.col("parts")).alias("f")).select("row", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns, without a hit."""
    return find_contamination(docs, benchmark, size).filter("n_hit = 0").select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    sha = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha, (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[pos:pos + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM item WHERE len(w) > 0)
), met AS (
  SELECT r, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS words
  FROM (SELECT r, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS pos FROM doc CROSS JOIN (SELECT DISTINCT size FROM win) AS s WHERE len(w) >= s.size)
), hit AS (
  SELECT m.r, m.pos, win.size, win.item FROM met AS m JOIN win USING (size, words)
), place AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS p FROM hit) GROUP BY r
), said AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (r) LEFT JOIN said USING (r)
"""
