"""Exact token ids and counts from caches of white-space chunks.

The libraries spend microseconds on each word. No pre-token of either vocabulary crosses a chunk as cut here,
so a chunk alone gives the ids it gives in its text, and a cache of chunks gives whole documents.
Caches are bounded in entries and in the length of what they hold; a full one starts again.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import xxhash

#: A cache holds that many chunks at most, none of more than ``CACHED_CHARS`` characters (bytes): some 200 MB.
CACHE_ENTRIES, CACHED_CHARS = 1_000_000, 64
#: Unicode White_Space, as the vocabularies' patterns have it (Python's \s would add U+001C to U+001F).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_COARSE = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space next to a space, or a space at either end: the pattern's look-ahead decides there.
_ODD = re.compile(rf" [{WHITE}]|[{WHITE}] | \Z")
#: Characters that normal form C leaves alone and that have one-to-one lower case.
_PLAIN = re.compile(r"[\x21-\x7eÀ-įı-ňŊ-ž]*\Z")
_PLAIN_SPACED = re.compile(r" ?[\x21-\x7eÀ-ſ]+\Z")
_LETTERS = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_WORD_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


_BYTE_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkCache(dict):
    """chunk -> value by ``encode(chunk)``; fills itself, and starts again when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk):
        value = self.encode(chunk)
        if len(chunk) <= CACHED_CHARS:
            self[chunk] = value
        return value

    def value(self, chunk):
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return self[chunk]

    def values_of(self, chunks):
        """The values of ``chunks``, in order."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return map(self.__getitem__, chunks)


class LengthTable:
    """pre-token -> number of ids, as an open-addressing hash table in four arrays: compact to broadcast, exact to read."""

    def __init__(self, lengths: dict[str, int]):
        tokens = [t.encode() for t in lengths]
        size = 1 << max(4, (2 * len(tokens)).bit_length())
        self.mask = size - 1
        self.slots = np.full(size, -1, np.int32)
        self.ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        self.ids = np.fromiter(lengths.values(), np.uint16, len(tokens))
        self.bytes = b"".join(tokens)
        for k, t in enumerate(tokens):
            at = xxhash.xxh32_intdigest(t) & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k

    def get(self, token: str) -> int:
        """Number of ids of ``token``; 0 if the table doesn't have it."""
        t = token.encode()
        at = xxhash.xxh32_intdigest(t) & self.mask
        while (k := self.slots[at]) >= 0:
            if self.bytes[self.ends[k] : self.ends[k + 1]] == t:
                return int(self.ids[k])
            at = (at + 1) & self.mask
        return 0

    def __len__(self) -> int:
        return len(self.ids)


def byte_level_chunks(text: str) -> list[str]:
    """Chunks for a vocabulary whose pre-tokens may begin with one space."""
    if _ODD.search(text):
        return _COARSE.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [f" {x}" for x in rest]


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def word_cache(tokenizer) -> ChunkCache:
    """chunk (bytes without white space) -> its ids as little-endian unsigned 32-bit integers.

    The parts of a chunk are chunks of the same cache: a second cache for them would hold most of its words twice.
    """
    stand_in, model = byte_alphabet(), tokenizer.model

    def encode(raw: bytes) -> bytes:
        chunk = raw.decode()
        if not _PLAIN.match(chunk) or "<|" in chunk:
            return _packed(tokenizer.encode(chunk, add_special_tokens=False).ids)
        parts = _WORD_PARTS.findall(chunk.lower())
        if parts == [chunk]:
            return _packed([t.id for t in model.tokenize(raw.decode("latin-1").translate(stand_in))])
        return b"".join([cache[x.encode()] for x in parts])

    cache = ChunkCache(encode)
    return cache


def byte_level_counter(tokenizer, table: LengthTable | None = None):
    """chunk of :func:`byte_level_chunks` -> its number of ids: its pre-tokens are looked up in ``table``, and a miss is
    encoded once for the worker's cache."""
    stand_in, model = byte_alphabet(), tokenizer.model
    parts = ChunkCache(lambda x: len(model.tokenize(x.encode().decode("latin-1").translate(stand_in))))
    known = table.get if table is not None else lambda x: 0

    def count(chunk: str) -> int:
        if "<|" in chunk:
            return len(tokenizer.encode(chunk, add_special_tokens=False))
        if _PLAIN_SPACED.match(chunk):
            return sum(known(x) or parts.value(x) for x in _BYTE_PARTS.findall(chunk))
        pieces = _COARSE.findall(chunk)
        return sum(map(count, pieces)) if len(pieces) > 1 else len(tokenizer.encode(chunk, add_special_tokens=False))

    return count


def pre_tokens(chunk: str) -> list[str]:
    """The pre-tokens of a plain chunk; none of another."""
    return _BYTE_PARTS.findall(chunk) if "<|" not in chunk and _PLAIN_SPACED.match(chunk) else []
