"""Borders of pre-tokens by array operations, for many texts at once.

The usual pattern of byte-level vocabularies (:data:`PATTERN`) looks at kinds of
characters only: letters, numbers, white space and others.  A pre-token is a run
of one kind, a single space before a run goes with it, the last character of
white space before a run stands apart from what precedes it, and an apostrophe
that starts a pre-token takes the letters of a short ending.  The kinds come
from the ``regex`` module, so the borders are those of its ``findall``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .bpe import PieceCache, gathered

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)
_ENDINGS = np.zeros((256, 256), dtype=bool)  # of an apostrophe and two letters
_ENDINGS[[*b"rvl"], [*b"eel"]] = True
_ENDING = np.zeros(256, dtype=bool)  # of an apostrophe and one letter
_ENDING[[*b"stmd"]] = True


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    return kinds


def _byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 is a part of."""
    kinds = _kinds()
    out = kinds[:256][data]
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        lead = data[first]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = (lead & (0x7F >> size)).astype(np.int32)
        for i in range(1, 4):
            more = np.flatnonzero(size > i)
            code[more] = code[more] << 6 | data[first[more] + i] & 0x3F
        kind = kinds[code]
        for i in range(4):
            more = size > i
            out[first[more] + i] = kind[more]
    return out


def borders(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token in a buffer of texts with one byte
    between them, whose first bytes are at ``firsts``."""
    size = len(data)
    data = np.append(data, np.zeros(3, dtype=np.uint8))
    kind = _byte_kinds(data)
    kind[firsts[1:] - 1] = _EDGE
    kind[size:] = _EDGE
    start = np.ones(len(data), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    # White space in front of a run: its last character stands apart, or goes
    # with the run if it is a space.
    gap = (kind[:-1] == _SPACE) & (kind[1:] < _SPACE)
    wide = np.flatnonzero(gap & (data[:-1] >= 0x80))
    joined = gap & (data[:-1] == 0x20)
    gap[wide] = False
    while len(wide):
        inner = (data[wide] & 0xC0) == 0x80
        gap[wide[~inner]] = True
        wide = wide[inner] - 1
    start[:-1] |= gap
    start[1:] &= ~joined
    marks = np.flatnonzero(data == 0x27)
    marks = marks[start[marks]]
    one, two = data[marks + 1], data[marks + 2]
    short, long = marks[_ENDING[one]], marks[_ENDINGS[one, two]]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    starts = np.flatnonzero(start[: size + 1])
    ends, starts = starts[1:], starts[:-1]
    inside = kind[starts] != _EDGE
    return starts[inside], ends[inside]


class PretokenCache(PieceCache):
    """Encodes texts whose pieces are the pre-tokens of :data:`PATTERN`, each
    remembered by itself."""

    def __init__(self, encode, dtype: str = "<u4"):
        super().__init__(regex.compile(PATTERN).findall, encode, dtype)

    @staticmethod
    def _pieces_of(data, firsts, parts):
        return borders(data, firsts)

    def _ids_at(self, data, buffer, starts, ends):
        lengths = ends - starts
        return self.encode(gathered(data, starts, lengths).tobytes(), lengths) if len(starts) else (self._none, lengths)
