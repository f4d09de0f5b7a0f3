"""Packing by lexical retrieval.

1.  Every text is encoded once; the ids are written to the shared folder, so that nothing below encodes again.
2.  Document frequencies of all terms, and the documents' number and mean length, are counted over the whole table; a vector of
    the vocabulary's size goes to the driver and back to the tasks.
3.  Documents that are alike are brought together from all over the table: each is dealt out by its TOP terms of most BM25 weight,
    the most widespread of these first, up to one that few documents have; so documents with a common subject meet in a task and
    lie side by side, and copies with them. A key without a rare term goes to several tasks, by a hash of the document.
4.  A shard of about SHARD tokens has a BM25 inverted index, with the frequencies of the whole table. For the document that a
    sequence starts with it gives the nearest unused documents, by all terms of that document, and these fill the sequence; the
    one that crosses its end is cut there and starts the next. An open sequence goes on into the next shard. A partition's last,
    partly filled sequence is dealt out over sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import HOT_SHARE, shared_dir, strings, trimmed
from folioforge.llm.encoding import load, word_encoder

SHARD = 1 << 19
#: Terms that a document is dealt out by.
TOP = 4
K1, B = 1.2, 0.75
FLUSH = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Corpus:
    """Documents in all, tokens of one in the mean, and the documents that have each term, by term."""

    documents: int
    mean: float
    df: np.ndarray

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a term, tf times in a document of so many tokens, adds to its score. A term that one document alone has adds nothing."""
        df = self.df[term]
        idf = np.where(df > 1, np.log1p((self.documents - df + 0.5) / (df + 0.5)), 0.0)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(1.0, self.mean)))


def term_counts(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of all documents, by document and term, and the documents' sizes."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    flat = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    key, tf = np.unique(np.repeat(np.arange(len(documents)), sizes) << 32 | flat.astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf, sizes


class Index:
    """BM25 over a shard's documents; the index forgets documents as they are used."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus):
        self.n = len(documents)
        doc, term, tf, sizes = term_counts(documents)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], corpus.weights(term, tf, sizes[doc])[order]
        self.terms, self.begin = np.unique(term[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.unused = np.ones(self.n, bool)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of each document, for a query of all the different ids."""
        query = np.unique(ids)
        slot = np.searchsorted(self.terms, query)
        slot = slot[(slot < len(self.terms)) & (self.terms[np.minimum(slot, len(self.terms) - 1)] == query)] if self.n else slot[:0]
        sizes = self.begin[slot + 1] - self.begin[slot]
        to = sizes.cumsum()
        at = np.repeat(self.begin[slot] - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n)

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """Unused documents by falling score; all of them, those that share no term last, in order."""
        left = np.flatnonzero(self.unused)
        return left[np.argsort(-self.scores(ids)[left], kind="stable")]


class Packer:
    """Deals documents out over sequences of `window` ids; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int, corpus: Corpus):
        self.window, self.sequence, self.corpus, self.filled, self.open = window, first_sequence, corpus, 0, []
        self.seed = None  # the ids of the document that the open sequence starts with

    def shard(self, documents: list[tuple]) -> Iterator[tuple]:
        """documents: (id, ids)."""
        index = Index([ids for _, ids in documents], self.corpus)
        left = len(documents)
        while left:
            near = np.flatnonzero(index.unused)[:1] if self.seed is None else index.neighbours(self.seed)
            for k in near:
                index.unused[k] = False
                left -= 1
                was = self.sequence
                yield from self.place(documents[k])
                if self.sequence != was or self.seed is None:
                    self.seed = documents[k][1]
                    break

    def place(self, document: tuple) -> Iterator[tuple]:
        start, size = 0, len(document[1])
        while start < size:
            length = min(size - start, self.window - self.filled)
            self.open.append((document, start, length, self.filled))
            self.filled += length
            start += length
            if self.filled == self.window:
                yield from ((d, s, n, self.sequence, o) for d, s, n, o in self.open)
                self.sequence, self.filled, self.open = self.sequence + 1, 0, []

    def rest(self) -> Iterator[tuple]:
        """The open sequence, dealt out over powers of two."""
        pieces, size = self.open, self.filled
        limit = 0
        offset = 0
        for document, start, length, _ in pieces:
            while length:
                if offset == limit:
                    if limit:
                        self.sequence += 1
                    limit, offset = 1 << (size.bit_length() - 1), 0
                    size -= limit
                take = min(length, limit - offset)
                yield document, start, take, self.sequence, offset
                start, length, offset = start + take, length - take, offset + take
        self.open, self.filled = [], 0


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """doc_id and ids (little-endian, of the type named) of each row, end_id last, read from the shared folder they are written to."""
    kind = "<u2" if max(load(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), np.array([end_id], kind)
        for batch in batches:
            low, rows, size = 0, [], 0
            for ids in encoder.encode(strings(batch.column("text"))):
                rows.append(np.concatenate([ids.astype(kind), end]).tobytes())
                size += len(rows[-1])
                if size >= 4 * FLUSH:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(rows)), pa.array(rows, pa.binary())], ["doc_id", "ids"])
                    low, rows, size = low + len(rows), [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(rows)), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    folder = shared_dir(docs.sparkSession, "tokens")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary").write.parquet(folder)
    return docs.sparkSession.read.schema("doc_id long, ids binary").parquet(folder), kind


def parts(column: pa.Array, kind: str) -> Iterator[list[np.ndarray]]:
    """The ids of a column's documents, so many together that it stays small."""
    held, size = [], 0
    for data in column:
        held.append(np.frombuffer(data.as_py(), kind).astype("<u4"))
        size += len(held[-1])
        if size >= FLUSH:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(tokens: DataFrame, kind: str) -> Corpus:
    """The corpus's counts: partial sums of each task, a row for each term at most, summed up by Spark. Terms are below 2^32."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for held in parts(batch.column("ids"), kind):
                _, term, _, sizes = term_counts(held)
                now = np.bincount(term, minlength=len(df))
                now[: len(df)] += df
                df, documents, total = now, documents + len(held), total + int(sizes.sum())
        term = np.flatnonzero(df)
        columns = [np.concatenate([[-1, -2], term]), np.concatenate([[documents, total], df[term]])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["term", "n"])

    rows = tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    documents, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(documents, total / max(1, documents), df)


def keys(documents: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """(documents, TOP): of each document the terms of most weight, the most widespread first; -1 where it has fewer."""
    doc, term, tf, sizes = term_counts(documents)
    weight = corpus.weights(term, tf, sizes[doc])
    order = np.lexsort([term, -weight, doc])
    order = order[weight[order] > 0]
    doc, term = doc[order], term[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    doc, term = doc[rank < TOP], term[rank < TOP]
    order = np.lexsort([term, -corpus.df[term], doc])
    doc, term = doc[order], term[order]
    out = np.full((len(documents), TOP), -1, np.int64)
    out[doc, np.arange(len(doc)) - np.searchsorted(doc, doc)] = term
    return out


def dealing(found: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """For each document's key a number that is equal where documents shall meet, and over how many tasks these are dealt out.

    The number stands for as many of the key's terms as it takes to come to one that few documents have; so at most so many meet.
    """
    few = max(1000, corpus.documents // HOT_SHARE)
    df = np.where(found >= 0, corpus.df[np.maximum(found, 0)], corpus.documents)
    rare = df <= few
    last = np.where(rare.any(axis=1), rare.argmax(axis=1), TOP - 1)
    number = np.zeros(len(found), np.uint64)
    for k in range(TOP):
        part = np.where(k <= last, found[:, k] + 2, 0).astype(np.uint64)
        number = (number ^ part) * np.uint64(0x9E3779B97F4A7C15)
        number ^= number >> np.uint64(29)
    return number.view(np.int64), np.where(rare.any(axis=1), 1, df[:, TOP - 1] // few + 1)


def dealt(tokens: DataFrame, kind: str, corpus: Corpus) -> DataFrame:
    """doc_id and ids, dealt out so that documents with a rare term of the key in common meet; rows stand in the order of the keys."""
    names = [f"t{k}" for k in range(TOP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for held in parts(batch.column("ids"), kind):
                found = keys(held, corpus)
                columns = [batch.column(c).slice(low, len(held)) for c in ("doc_id", "ids")]
                own = [pa.array(x.astype(np.int64)) for x in (*dealing(found, corpus), *found.T)]
                yield pa.RecordBatch.from_arrays([*columns, *own], ["doc_id", "ids", "number", "tasks", *names])
                low += len(held)

    keyed = tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id long, ids binary, number long, tasks long, {', '.join(f'{c} long' for c in names)}")
    keyed = keyed.withColumn("h", F.xxhash64("doc_id", "ids"))
    keyed = keyed.withColumn("deal", F.xxhash64("number", F.pmod("h", "tasks")))
    return keyed.repartition("deal").sortWithinPartitions(*names, "h", "doc_id", "ids").select("doc_id", "ids")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id, the end id of each document with them, lies in one piece. A null text is empty and gives its end id alone; repeated
    rows are documents of their own; null ids stay null. A sequence lies within one partition, whose number is the upper half of
    its id. One shuffle, of the ids; a task holds one shard, or one document where that is larger. An empty table gives no rows;
    other columns are not read.
    """
    tokens, kind = encoded(docs, tokenizer_path, end_id)
    corpus = counted(tokens, kind)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32, corpus)
        held, size = [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append((doc_id, np.frombuffer(data.as_py(), kind).astype("<u4")))
                size += len(held[-1][1])
                if size >= SHARD:
                    yield from written(packer.shard(held))
                    held, size = [], 0
        yield from written(packer.shard(held))
        yield from written(packer.rest())

    def written(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for (doc_id, ids), start, length, sequence, offset in pieces:
            rows.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset))
            size += length
            if size >= FLUSH:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return dealt(tokens, kind, corpus).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
