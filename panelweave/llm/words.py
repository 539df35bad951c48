"""Hashes of words and word runs, for many texts at once in numpy.

A word is a maximal run of characters other than space, tab, line feed,
vertical tab, form feed and carriage return.  Its hash is a polynomial of its
bytes modulo 2^64, taken from prefix sums over a whole buffer and mixed by a
finaliser, so the cost per byte is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that are hashed at once; a longer word is hashed on its own.
BUFFER = 1 << 20
_RNG = np.random.default_rng(20240611)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers for the words of a run, by place from the end.
STEP = int(_RNG.integers(1 << 62, 1 << 63)) | 1

_tables: dict[str, np.ndarray] = {}


def _powers(base: int, count: int, name: str) -> np.ndarray:
    held = _tables.get(name)
    if held is None or len(held) < count:
        size = max(count, BUFFER + 1)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= BUFFER + 1:
            _tables[name] = held
    return held[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _buffer_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, dtype=np.uint8)
    edge = np.zeros(len(data) + 2, dtype=np.int8)
    edge[1:-1] = ~_SPACE[data]
    change = np.diff(edge)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data), "up"), out=sums[1:])
    inverse = _powers(_INVERSE, len(data) + 1, "down")
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def bytes_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each range of bytes."""
    out = []
    for name, base, values in (("", _BASE, _BYTE), ("other", STEP, mix(_BYTE))):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * _powers(base, len(data), f"up{name}"), out=sums[1:])
        inverse = _powers(pow(base, -1, 1 << 64), len(data) + 1, f"down{name}")
        out.append(mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def word_hashes(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    held: list[bytes] = []
    size = 0
    for raw in texts:
        if len(raw) >= BUFFER:
            yield from _together(held)
            held, size = [], 0
            yield np.concatenate([_buffer_hashes(part)[0] for part in _parts(raw)])
            continue
        if size + len(raw) >= BUFFER:
            yield from _together(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    yield from _together(held)


def _together(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    hashes, starts = _buffer_hashes(b"\n".join(texts))
    ends = np.cumsum([len(raw) + 1 for raw in texts])
    yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text cut at white space into parts of about a buffer each."""
    at = 0
    while at < len(raw):
        stop = at + BUFFER
        while stop < len(raw) and not _SPACE[raw[stop]]:
            stop += 1
        yield raw[at:stop]
        at = stop


def run_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``size`` consecutive words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    step = (STEP + 2 * seed) % (1 << 64)
    start = mix(words + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))) if seed else words
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(start * _powers(step, len(words), f"run{seed}"), out=sums[1:])
    back = _powers(pow(step, -1, 1 << 64), len(words), f"back{seed}")
    return mix((sums[size:] - sums[:-size]) * back[:count] + np.uint64(size))
