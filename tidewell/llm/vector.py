"""Vectorised scanning of text columns: words, hashes and sliding minima over raw UTF-8 buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
#: A random value for every byte, so that short words differ in all bits.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


def _table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any slice of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * _table(int(_BASE), n), out=self.prefix[1:])
        self.back = _table(int(_INVERSE), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of ``k`` values."""
        n = len(self.prefix) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.prefix[k:] - self.prefix[:n]) * self.back[:n])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    out, first, n = [], 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        out.append((first, last))
        first = last
    return out


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray, values: np.ndarray = LOWER_VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row numbers and hashes of the words, maximal runs of the bytes in ``table`` within a row."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, np.zeros(0, np.uint64)
    inside = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(inside & after) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows, Rolling(values[data])(starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of ``w`` values, by doubling."""
    have, width = x, 1
    while width < w and len(have):
        step = min(width, w - width)
        have = np.minimum(have[:-step], have[step:]) if len(have) > step else have[:0]
        width += step
    return have
