"""Pre-splitting of text for byte-level BPE vocabularies, with a bounded memo of what each piece encodes to."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: The pre-splitting pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a memo's younger half; when it is full it becomes the older one, and entries in use move back.
MEMO_PIECES = 150_000
_MEMO_CHARS = 64
_SPLIT = regex.compile(PATTERN)


class _Uneven(Exception):
    """Cutting at each space is not the same as the pattern: a space stands before white space or at an end."""


@lru_cache(2)
def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """A vocabulary file of the driver's (some megabytes) for all executors, which may not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the other bytes from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """What short keys map to, computed on first use; holds at most twice ``limit``."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.old.get(key)) is None:
            found = self.compute(key)
        if len(key) <= _MEMO_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Pieces:
    """Encodes texts piece by piece; ``encode(word)`` gives the ids of one pre-split word as int32 bytes."""

    def __init__(self, special: dict[str, int], encode: Callable[[str], bytes], memo: int = MEMO_PIECES):
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words, self.memo = Memo(encode, memo), Memo(self._piece, memo)

    def _piece(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise _Uneven
        word = " " + piece
        # kept by the caller's memo under the piece: once is enough
        return self.words.compute(word) if piece.isascii() and piece.isalpha() else self._slow(word)

    def _slow(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and not first:
            return self._slow(text)
        try:
            return self._slow(first) + b"".join(map(self.memo.__getitem__, rest))
        except _Uneven:
            return self._slow(text)

    def ids(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), np.int32)
