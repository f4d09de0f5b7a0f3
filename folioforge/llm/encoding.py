"""Tokenizing whole texts with a public tokenizer file through a bounded memo.

A tokenizer that never joins characters across white space gives a text the tokens of its pieces, one piece after another.
The library encodes each distinct piece once for each Python worker; a text is then looked up piece by piece.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker keeps, and as many pre-tokens; at about 150 bytes each, some 100 MB. A full memo takes no more.
MEMO_PIECES = 300_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts with another character than these are left to the library as a whole. These need no normal form, each folds to one character.
OTHER = re.compile(f"[^ \\t\\n\\r!-~{LETTERS}]")
#: Where pieces cut at spaces would not be whole pre-tokens.
UNEVEN = re.compile("  |[\\n\\t\\r] |[\\t\\r]")
#: The two tokenizers' pre-token patterns, over those characters.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Characters looked at together.
TOGETHER = 3_000_000


def load(path: str):
    """The tokenizer of a .json file, one thread, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


LETTER = byte_letters()


def spelled(token: str) -> str:
    """A pre-token as the byte-level vocabulary spells it."""
    return "".join([LETTER[b] for b in token.encode()])


class Memo(dict):
    """Remembers what `make` gave for the first `limit` keys; later ones are made anew each time. Frequent keys come early."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.left = make, limit

    def __missing__(self, key):
        made = self.make(key)
        if self.left:
            self.left -= 1
            self[key] = made
        return made


def together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about TOGETHER characters."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text or "")
        if n >= TOGETHER:
            yield part
            part, n = [], 0
    if part:
        yield part


def pieces_of(lists: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The end of each list, the distinct strings, and for each string of the lists in order its place among those."""
    coded = lists.flatten().dictionary_encode()
    return np.diff(lists.offsets.to_numpy()).cumsum(), coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Tokens:
    def __init__(self, path: str, limit: int = MEMO_PIECES):
        self.library, self.pieces = load(path), Memo(self.piece, limit)
        self.merge, self.added = self.library.model.tokenize, self.library.get_added_tokens_decoder()
        self.special = [t.content for t in self.added.values()]

    def odd(self, text: str) -> bool:
        return bool(OTHER.search(text)) or any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class WordEncoder(Tokens):
    """Ids of texts for a tokenizer that folds case and drops white space.

    Two memos, of pieces between white space and of pre-tokens, keep what the library's merges gave before.
    """

    def __init__(self, path: str, limit: int = MEMO_PIECES):
        super().__init__(path, limit)
        self.words = Memo(self.word, limit)

    def piece(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(piece)))

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.merge(word if word.isascii() else spelled(word))]).tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """For each text in order its ids, unsigned 32-bit; none for null."""
        for part in together(texts):
            odd = {i: np.array(self.ids(t), "<u4") for i, t in enumerate(part) if t and self.odd(t)}
            ends, distinct, at = pieces_of(pc.ascii_split_whitespace(pa.array(["" if i in odd else (t or "").lower() for i, t in enumerate(part)], pa.string())))
            coded = list(map(self.pieces.__getitem__, distinct))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            begins, table = sizes.cumsum() - sizes, np.frombuffer(b"".join(coded), "<u4")
            sizes = sizes[at]
            to = sizes.cumsum()
            ids = table[np.repeat(begins[at] - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)]
            to = np.concatenate([[0], to])[np.concatenate([[0], ends])]
            for i in range(len(part)):
                yield odd[i] if i in odd else ids[to[i] : to[i + 1]]


class TokenCounter(Tokens):
    """Numbers of tokens of texts for a byte-level tokenizer whose pre-tokens start with at most one space or are white space.

    The whole-token shortcut: every string of the vocabulary that the library, asked for it alone, encodes as that one token,
    is proven to count 1 (`proven`, before any text is read). A pre-token that is such a string is counted without merging; the
    library merges the others, and a memo keeps the counts. A pre-token never runs from a non-space into a space, so a text can
    be cut before each space that follows a non-space.
    """

    def __init__(self, path: str, whole: frozenset[str], limit: int = MEMO_PIECES):
        super().__init__(path, limit)
        self.whole, self.tokens, self.firsts = whole, Memo(self.token, limit), Memo(lambda x: len(self.ids(x)), limit // 4)

    def piece(self, piece: str) -> int:
        """Tokens of a piece with a space before it."""
        return sum(map(self.tokens.__getitem__, PRE_TOKENS.findall(" " + piece)))

    def token(self, token: str) -> int:
        return 1 if token in self.whole else len(self.merge(spelled(token)))

    def count(self, texts: Iterable[str | None]) -> Iterator[int]:
        """For each text in order its number of tokens; 0 for null."""
        for part in together(texts):
            slow = {i: len(self.ids(t)) if self.odd(t) else sum(map(self.tokens.__getitem__, PRE_TOKENS.findall(t))) for i, t in enumerate(part) if t and (UNEVEN.search(t) or self.odd(t))}
            plain = ["" if i in slow else t or "" for i, t in enumerate(part)]
            ends, distinct, at = pieces_of(pc.split_pattern(pa.array([f" {t}" for t in plain], pa.string()), " "))
            counts = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))[at]
            begins = np.concatenate([[0], ends[:-1]])
            # of each text's pieces, the first is what stands before the space put there, and the second has no space of its own
            counts[begins] = 0
            counts[begins + 1] = [self.firsts[x] if (x := t.partition(" ")[0]) else 0 for t in plain]
            sums = np.add.reduceat(counts, begins)
            for i in range(len(part)):
                yield slow[i] if i in slow else int(sums[i])


@lru_cache(2)
def proven(path: str) -> frozenset[str]:
    """Vocabulary strings, as texts, that alone encode as one token; at most as many as the vocabulary has."""
    library = load(path)
    added = library.get_added_tokens_decoder()
    ids = [i for i in library.get_vocab().values() if i not in added]
    texts = library.decode_batch([[i] for i in ids], skip_special_tokens=False)
    coded = library.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for i, t, x in zip(ids, texts, coded) if x.ids == [i])


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


_counters: dict[str, TokenCounter] = {}


def token_counter(path: str, whole: frozenset[str]) -> TokenCounter:
    """One for each Python worker."""
    if path not in _counters:
        _counters[path] = TokenCounter(path, whole)
    return _counters[path]
