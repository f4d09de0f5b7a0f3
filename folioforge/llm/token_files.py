"""Token ids in a binary file format: independent zstandard frames, a document index and a trailing seek table.

A file holds documents in ascending doc_id order. Layout, all numbers little-endian:

    data frames   ids, 2 or 4 bytes each, about FRAME_BYTES a frame; a document may span frames
    skippable     magic 0x184D2A50, its content's size u32, then the id width u8, the document count u64, and one zstandard frame of
                  the document index: (doc_id i64, whether it is null u8, first byte u64, bytes u64) x documents, 25 bytes each
    skippable     magic 0x184D2A5E: the seek table of the public zstandard seekable format: for each data frame its compressed
                  size, its size and the low 32 bits of the XXH64 of its content (u32 each), then the number of frames u32,
                  the descriptor byte 0x80 (checksums present) and the magic 0x8F92EAB1

A first byte counts the data frames' uncompressed bytes. Both skippable frames start with their magic and size, u32 each. Any zstandard reader decompresses the data frames; this one reads the tail, then only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import strings, trimmed
from folioforge.llm.encoding import word_encoder

FRAME_BYTES = 1 << 18
INDEX_MAGIC, SEEK_MAGIC, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<u8"), ("bytes", "<u8")])
FRAME = np.dtype([("compressed", "<u4"), ("bytes", "<u4"), ("checksum", "<u4")])


class TokenFileWriter:
    """Writes documents in the order given to a binary stream."""

    def __init__(self, out, width: int, level: int = 3):
        self.out, self.width, self.zstd = out, width, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.buffer, self.at, self.frames, self.documents = bytearray(), 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.documents.append((doc_id or 0, doc_id is None, self.at, len(data)))
        self.at += len(data)
        self.buffer += data
        while len(self.buffer) >= FRAME_BYTES:
            self.flush(FRAME_BYTES)

    def flush(self, size: int) -> None:
        data = bytes(self.buffer[:size])
        del self.buffer[:size]
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self.flush(len(self.buffer))
        index = struct.pack("<BQ", self.width, len(self.documents)) + self.zstd.compress(np.array(self.documents, DOCUMENT).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, FRAME).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFileReader:
    """Random access to a file's documents; each frame that is read is held against its checksum."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        count, flags, magic = struct.unpack("<IBI", self.read(end - 9, 9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("not a token file")
        table = end - 9 - count * FRAME.itemsize
        self.frames = np.frombuffer(self.read(table, count * FRAME.itemsize), FRAME)
        self.place = np.concatenate([[0], self.frames["compressed"].astype(np.int64).cumsum()])
        self.begin = np.concatenate([[0], self.frames["bytes"].astype(np.int64).cumsum()])
        index = self.read(int(self.place[-1]) + 8, table - 8 - int(self.place[-1]) - 8)
        self.width, documents = struct.unpack("<BQ", index[:9])
        self.documents = np.frombuffer(self.zstd.decompress(index[9:]), DOCUMENT, documents)
        self.held = (-1, b"")

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            data = self.zstd.decompress(self.read(int(self.place[k]), int(self.frames[k]["compressed"])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k]["checksum"]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def ids(self, n: int) -> np.ndarray:
        """The ids of the n-th document."""
        first, size = int(self.documents[n]["first"]), int(self.documents[n]["bytes"])
        k, parts = int(np.searchsorted(self.begin, first, "right")) - 1, []
        while size:
            at = first - int(self.begin[k])
            parts.append(self.frame(k)[at : at + size])
            first, size, k = first + len(parts[-1]), size - len(parts[-1]), k + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}")

    def of(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents of that id, found by bisection."""
        rows = self.documents
        nulls = int(rows["null"].sum())  # they come first
        low, high = (0, nulls) if doc_id is None else (nulls + int(np.searchsorted(rows["doc_id"][nulls:], doc_id, side)) for side in ("left", "right"))
        return [self.ids(n) for n in range(low, high)]


def settle(store: fs.FileSystem, held: str, name: str) -> None:
    """Puts a file in its place. Where an attempt that ran before has left the file, which has the same content, that one stays:
    not every store can rename onto a file that is there."""
    if store.get_file_info(name).type == fs.FileType.NotFound:
        try:
            store.move(held, name)
            return
        except OSError:
            if store.get_file_info(name).type == fs.FileType.NotFound:
                raise
    store.delete_file(held)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None) -> list[tuple[str, int, int]]:
    """Encode every whole text of docs, append end_id, and write files whose names ascend with doc_id; (path, documents, ids) of each.

    A null text is empty, a null doc_id comes before all others, repeated doc_ids stand by a hash of their texts, then by the
    texts. Range partitioning deals documents out by doc_id and that hash, so an id of very many rows goes to several tasks; a file
    is written under the attempt's name and renamed, so a task that runs twice leaves one file, with the same content. `folder` is
    a URI that pyarrow can write to (file, hdfs, s3, gs), shared by all executors. Other columns are not read.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_encoder(tokenizer_path), TaskContext.get()
        width = 2 if encoder.library.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}.tokens"
        held = f"{path}/.{name}.{task.taskAttemptId()}"
        end, total, writer = np.array([] if end_id is None else [end_id], "<u4"), 0, None
        with store.open_output_stream(held) as out:
            writer = TokenFileWriter(out, width)
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(strings(batch.column("text")))):
                    writer.add(doc_id, np.concatenate([ids, end]))
                    total += len(ids) + len(end)
            writer.close()
        if writer.documents:
            settle(store, held, f"{path}/{name}")
            row = [[name], [len(writer.documents)], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64())], ["name", "documents", "ids"])
        else:
            store.delete_file(held)

    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    written = dealt.mapInArrow(run, "name string, documents long, ids long")
    return [(f"{folder}/{r.name}", r.documents, r.ids) for r in sorted(written.collect())]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as source:
                    reader = TokenFileReader(source)
                    rows, step = reader.documents, 20_000
                    for low in range(0, len(rows), step):
                        part = rows[low : low + step]
                        ids = [zlib.crc32(reader.ids(n).astype("<u4").tobytes()) for n in range(low, low + len(part))]
                        start, size = ((part[c] // reader.width).astype(np.int64) for c in ("first", "bytes"))
                        columns = [pa.array(part["doc_id"], mask=part["null"].astype(bool)), pa.array(base + start), pa.array(size), pa.array(ids, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    bases = [0, *np.cumsum([n for _, _, n in files]).tolist()]
    named = [(uri, base) for (uri, _, _), base in zip(files, bases)]
    listed = spark.createDataFrame(named, "uri string, base long").repartition(max(1, len(named)), "uri")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
