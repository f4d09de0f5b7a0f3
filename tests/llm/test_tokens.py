import io
import random
import zlib

import numpy as np
import pytest
import xxhash

from folioforge.llm import encoding, token_counts, token_files
from folioforge.llm.common import shared_dir

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
PARTS = [*"aB  \n\n\t\r' 12é,.", "\x1c", "\x85", "\xa0", "　", "é", "́", "Σ", "İ", "ß", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "中", "١", "²", "​", "😀", "word", "Tokens"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS if k % 2 else PARTS[:17] + PARTS[-2:]) for _ in range(r.randint(0, 16))) for k in range(n)]


def test_pieces_give_what_the_library_gives(monkeypatch):
    monkeypatch.setattr(encoding, "TOGETHER", 500)
    every = [*texts(4000), None, "long word" * 3000]
    word, byte = encoding.load(WORD), encoding.load(BYTE)
    for x, t in zip(encoding.WordEncoder(WORD, 50).encode(every), every, strict=True):
        assert x.tolist() == word.encode(t or "", add_special_tokens=False).ids, t
    for n, t in zip(encoding.TokenCounter(BYTE, encoding.proven(BYTE), 50).count(every), every, strict=True):
        assert n == len(byte.encode(t or "", add_special_tokens=False).ids), t


def test_counts(frame):
    rows = [(1, "hello world"), (2, None), (2, None), (None, ""), (3, "é " * 2000)]
    got = sorted(map(tuple, token_counts.count_tokens(frame(rows, extra="n_bytes"), BYTE).collect()), key=repr)
    n = len(encoding.load(BYTE).encode("é " * 2000, add_special_tokens=False).ids)
    assert got == sorted([(1, 11, 2, False), (2, 0, 0, False), (2, 0, 0, False), (None, 0, 0, False), (3, 6000, n, n > 1024)], key=repr)
    assert token_counts.count_tokens(frame([]), BYTE).count() == 0


def test_files_round_trip(frame, spark):
    rows = [(i, t) for i, t in enumerate(texts(300, 2))] + [(None, "null id"), (7, "again"), (7, None), (-5, ""), (999, "many words " * 40_000)]
    files = token_files.write_token_files(frame(rows, extra="start"), shared_dir(spark, "test"), WORD, 2)
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r.start)
    library, at = encoding.load(WORD), 0
    signed = lambda t: 42 if t is None else (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r, (i, t) in zip(got, order):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(frame([]), shared_dir(spark, "test"), WORD, 2)).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_reader_finds_documents_and_damage(monkeypatch, width):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    out, r = io.BytesIO(), np.random.default_rng(1)
    docs = [(None, r.integers(0, 60_000, 5)), *((k // 2, r.integers(0, 60_000, int(r.integers(0, 90)))) for k in range(40))]
    writer = token_files.TokenFileWriter(out, width)
    for i, ids in docs:
        writer.add(i, ids.astype("<u4"))
    writer.close()
    reader = token_files.TokenFileReader(out)
    for i in {d for d, _ in docs}:
        assert [x.tolist() for x in reader.of(i)] == [ids.tolist() for d, ids in docs if d == i]
    assert reader.of(12345) == []
    data = bytearray(out.getvalue())
    data[len(data) - 9 - 4] ^= 1  # the last frame's checksum
    with pytest.raises(ValueError):
        token_files.TokenFileReader(io.BytesIO(bytes(data))).frame(len(reader.frames) - 1)


def test_format_is_as_it_is_described(monkeypatch):
    """A reader written from the module's text alone."""
    import struct

    import zstandard

    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out, 2)
    docs = [(None, [1, 2]), (-5, []), (8, list(range(100)))]
    for i, ids in docs:
        writer.add(i, np.array(ids, "<u4"))
    writer.close()
    data = out.getvalue()
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    table = len(data) - 9 - 12 * frames
    assert struct.unpack("<II", data[table - 8 : table]) == (0x184D2A5E, 12 * frames + 9)
    plain, at = b"", 0
    for k in range(frames):
        size, whole, check = struct.unpack_from("<III", data, table + 12 * k)
        part = zstandard.ZstdDecompressor().decompress(data[at : at + size])
        assert len(part) == whole and xxhash.xxh64_intdigest(part) & 0xFFFFFFFF == check
        plain, at = plain + part, at + size
    magic, size, width, count = struct.unpack_from("<IIBQ", data, at)
    assert (magic, width, count) == (0x184D2A50, 2, 3) and at + 8 + size == table - 8
    index = zstandard.ZstdDecompressor().decompress(data[at + 17 : at + 8 + size])
    got = []
    for k in range(count):
        doc_id, null, first, n = struct.unpack_from("<qBQQ", index, 25 * k)
        got.append((None if null else doc_id, np.frombuffer(plain[first : first + n], "<u2").tolist()))
    assert got == docs


def test_a_file_that_an_earlier_attempt_left_stays(tmp_path):
    from pyarrow import fs

    class Strict(fs.LocalFileSystem):
        """Refuses to rename onto a file that is there."""

        def move(self, src, dest):
            if self.get_file_info(dest).type != fs.FileType.NotFound:
                raise OSError("there already")
            super().move(src, dest)

    store = Strict()
    for _ in range(2):
        (tmp_path / "held").write_text("x")
        token_files.settle(store, str(tmp_path / "held"), str(tmp_path / "final"))
    assert [f.name for f in tmp_path.iterdir()] == ["final"]
