"""Words of whole texts as hashed numpy arrays, for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers kept for each base; a longer text's are made anew and let go.
KEPT = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the decontamination contract: ASCII other than digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = np.cumprod(x, dtype=np.uint64)
        if n <= KEPT:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    size = int(off[-1] - off[0])
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if size else np.zeros(0, np.uint8)), off - off[0]


class Words:
    """start, end: byte range of each word; first: index of each text's first word, one more at the end."""

    def __init__(self, col: pa.Array, sep: np.ndarray = SPACE, lower: bool = False):
        self.data, self.offsets = raw(col)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~sep[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        starts, ends = inside.copy(), inside.copy()
        if n:
            starts[1:] &= ~inside[:-1] | cut[1:n]
            ends[:-1] &= ~inside[1:] | cut[1:n]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial over random byte values, then mixed."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _pow(_BASE, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _pow(_INV, n + 1)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))


_PLACE = [np.uint64(int(x)) for x in _rng.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        total += h[k : k + n] * _PLACE[k]
    return mix(total)
