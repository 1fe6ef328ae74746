"""Pre-tokenization with memory: text -> ids, asking a piece encoder once per distinct piece.

The patterns of byte-level vocabularies put an edge before every space that follows a visible
character, and around a line feed between two visible characters. So a text falls into chunks at
single spaces and line feeds, and a chunk's ids don't depend on its neighbours. A text with other
runs of white space takes the pattern over its whole length instead.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Remembered chunks and pieces; an entry takes about 200 bytes of a Python worker.
CHUNK_ENTRIES = 200_000
PIECE_ENTRIES = 100_000
KEY_CHARS = 40


class _Uneven(Exception):
    """A chunk that is empty or begins or ends with white space."""


class _Memo(dict):
    """key -> ids as bytes, at most ``limit`` entries; starts afresh when full."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= KEY_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = found
        return found


class PieceEncoder:
    """Ids of texts as bytes of fixed-width integers; ``encode_piece`` gives those of one piece."""

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], chunks: int = CHUNK_ENTRIES, pieces: int = PIECE_ENTRIES):
        self.split = regex.compile(pattern).findall
        self.pieces = _Memo(encode_piece, pieces)
        self.after_space = _Memo(lambda c: self._chunk(c, " " + c), chunks)
        self.at_start = _Memo(lambda c: self._chunk(c, c), chunks // 5)
        self.line_feed = self.by_pattern("\n")

    def _chunk(self, chunk: str, whole: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Uneven
        return self.by_pattern(whole)

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        start, rest, out = self.at_start.__getitem__, self.after_space.__getitem__, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(start(words[0]))
                del words[0]
                out.extend(map(rest, words))
                out.append(self.line_feed)
        except _Uneven:
            return self.by_pattern(text)
        out.pop()
        return b"".join(out)
