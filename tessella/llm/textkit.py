"""Vectorised word hashing over Arrow string columns.

Words are maximal byte runs outside space and tab..carriage return, which is the
pattern ``[^\\x20\\x09-\\x0D]+``; the separators are ASCII, so UTF-8 bytes can be
scanned without decoding. No Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_ROLL = U64(0xD1342543DE82EF95 | 1)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 1 << 22:  # a longer one serves one very long text and goes with it
            _powers[int(base)] = got
    return got[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offs


def pieces(column: pa.Array, limit: int = 1 << 18):
    """(first row, bytes, local offsets) for runs of whole texts of about `limit` bytes."""
    data, offs = buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """Word starts, ends, rows and hashes of one piece; `spans` are starts and ends if other parts than words are meant."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, fold: bool = False, spans: tuple[np.ndarray, np.ndarray] | None = None):
        self.start, self.stop = self._scan(data, offs) if spans is None else spans
        n = len(data)
        sums = np.zeros(n + 1, U64)
        np.cumsum((_FOLDED if fold else _BYTES)[data] * powers(_BASE, n), out=sums[1:])
        self.hash = mix((sums[self.stop] - sums[self.start]) * powers(_BASE_INV, n + 1)[self.start])
        # first word of each row, n rows + 1
        self.first = np.searchsorted(self.start, offs)

    @staticmethod
    def _scan(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~SEPARATOR[data]
        start, stop = inside.copy(), inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            firsts = offs[:-1][offs[:-1] < offs[1:]]
            start[firsts] = inside[firsts]
            lasts = offs[1:][offs[:-1] < offs[1:]] - 1
            stop[lasts] = inside[lasts]
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    def spans(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and row of every run of k words that lies in one row."""
        counts = np.maximum(np.diff(self.first) - k + 1, 0)
        rows = np.repeat(np.arange(len(counts)), counts)
        return ramp(counts) + self.first[:-1][rows], rows


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def rolled(hashes: np.ndarray, starts: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Order-dependent 64-bit hash of the k word hashes from each start."""
    h = mix(hashes ^ U64(salt)) if salt else hashes
    out = np.zeros(len(starts), U64)
    if k <= 8:
        for i in range(k):
            out = mix(out * _ROLL + h[starts + i])
        return out
    n = len(h)
    sums = np.zeros(n + 1, U64)
    np.cumsum(h * powers(_ROLL, n), out=sums[1:])
    inverse = powers(U64(pow(int(_ROLL), -1, 1 << 64)), n + 1)
    return mix((sums[starts + k] - sums[starts]) * inverse[starts])


def spanned(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int = 0) -> np.ndarray:
    """Like `rolled` for runs of different lengths; the length is part of the hash."""
    h = mix(hashes ^ U64(salt)) if salt else hashes
    n = len(h)
    sums = np.zeros(n + 1, U64)
    np.cumsum(h * powers(_ROLL, n), out=sums[1:])
    inverse = powers(U64(pow(int(_ROLL), -1, 1 << 64)), n + 1)
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(U64) * _BASE)
