"""Flat-array text kernels: every text of an Arrow batch lies in one byte array and is worked on by numpy at once.

A polynomial hash over prefix sums gives the hash of any byte range in O(1), so words, lines and
sentences of a whole batch are hashed without a Python loop over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one numpy pass works on at most, unless a single text is longer.
CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


_BYTE_CODES = seeded(256, 7)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 16)
        base = np.full(size, _ODD if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base)
    return have[:n]


class RangeHash:
    """Hashes of any ranges of one flat array of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _power("up", n), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        down = _power("down", int(starts.max()) + 1)
        return splitmix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes, whole texts each."""
    data, off = utf8(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross an offset."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[off] = True
    cut[1:-1] |= mask[1:] != mask[:-1]
    cut[0] = cut[-1] = True
    at = np.flatnonzero(cut)
    on = mask[at[:-1]]
    return at[:-1][on], at[1:][on]


def counts_in(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets of sorted ``positions`` among the texts that ``off`` bounds."""
    return np.searchsorted(positions, off, "left").astype(np.int64)


def sums_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets; 0 for an empty range."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def owners(off: np.ndarray) -> np.ndarray:
    """The text number of each item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def space_mask(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


class Words:
    """Words of a chunk: maximal runs of ASCII letters, digits and non-ASCII bytes, ASCII case folded.

    ``starts``/``ends`` are byte positions, ``hashes`` 64-bit, ``off`` the words of each text.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.starts, self.ends = runs(_TOKEN[data], off)
        self.hashes = RangeHash(_BYTE_CODES[_LOWER[data]])(self.starts, self.ends)
        self.off = counts_in(self.starts, off)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``size``-word windows and their offsets; a text of fewer words, but one at least, is one shingle."""
        n = np.diff(self.off)
        many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        off = np.zeros(len(n) + 1, np.int64)
        np.cumsum(many, out=off[1:])
        first = np.repeat(self.off[:-1], many) + np.arange(off[-1]) - np.repeat(off[:-1], many)
        last = np.minimum(first + size, np.repeat(self.off[1:], many))
        out = np.zeros(off[-1], np.uint64)
        for k, factor in enumerate(seeded(size, 99)):
            at = first + k
            inside = at < last
            out[inside] += self.hashes[at[inside]] * (factor | np.uint64(1))
        return splitmix(out), off


def distinct(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, how often each stands there, and the new offsets."""
    owner = owners(off)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(o[at], np.arange(len(off)), "left").astype(np.int64)


def int64(values: np.ndarray) -> pa.Array:
    """A long column; unsigned hashes keep their bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
