"""Vectorised views of text columns: Arrow buffers as numpy bytes, words and 64-bit word hashes.

Nothing here knows Spark; the operators call it inside tasks, one bounded slice of whole documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240611)
#: Hashes are polynomials over a prime field, so that no structure of a text makes two spans collide.
PRIME = (1 << 31) - 1
_P, _SHIFT = U64(PRIME), U64(31)
_BYTE = _RNG.integers(1, PRIME, 256).astype(U64)
#: Two independent points for each family of 62-bit hashes.
_POINTS = _RNG.integers(1 << 20, PRIME - 1, (2, 2)).tolist()

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words: white space, or everything in ASCII but digits and letters.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[97:123] = NON_ALNUM[65:91] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A number that is the same modulo PRIME, below 2**34 for any 64 bits."""
    return (x & _P) + (x >> _SHIFT)


def _residue(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


def powers(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """point**i and point**-i modulo PRIME for i < n at least; grown by doubling and kept for the task's process."""
    if point not in _powers or len(_powers[point][0]) < n:
        made = []
        for base in (point, pow(point, -1, PRIME)):
            p = np.ones(1, U64)
            while len(p) < max(n, 1 << 16):
                p = np.concatenate([p, _residue(p * U64(pow(base, len(p), PRIME)))])
            made.append(p)
        _powers[point] = (made[0], made[1])
    return _powers[point]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, lower-cased: their row, first byte, end and 64-bit hash, in text order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64)
    inside = ~separator[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cut = offsets[(offsets > 0) & (offsets < n)]
    both = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
    marks = np.flatnonzero(edge)
    if len(both):  # rows that touch without a separator
        marks = np.sort(np.concatenate([marks, np.unique(both), np.unique(both)]))
    begin, end = marks[0::2], marks[1::2]
    return np.searchsorted(offsets, begin, "right") - 1, begin, end, span_hash(LOWER[data], begin, end)


class Sums:
    """Prefix sums of a sequence of codes (1 to PRIME - 1), from which the hash of any span is taken."""

    def __init__(self, codes: np.ndarray, family: int = 0):
        self.points, self.size = _POINTS[family], len(codes)
        self.sums = np.zeros((2, len(codes) + 1), U64)
        for out, point in zip(self.sums, self.points, strict=True):
            np.cumsum(_fold(codes * powers(point, len(codes) + 1)[0][: len(codes)]), out=out[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal codes give equal hashes wherever they stand."""
        one, two = (_residue(_fold(s[end] - s[begin]) * powers(p, self.size + 1)[1][begin]) for s, p in zip(self.sums, self.points, strict=True))
        with np.errstate(over="ignore"):
            return mix((one | (two << U64(32))) + (end - begin).astype(U64) * U64(0x9E3779B97F4A7C15))


def prefix(data: np.ndarray, family: int = 0) -> Sums:
    """Prefix sums of bytes; hashes of different families are independent."""
    return Sums(_BYTE[data], family)


def span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    return prefix(data).hashes(begin, end)


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 16 bytes at each place that has as many; distinct bytes hardly ever collide."""
    if len(data) < 16:
        return np.zeros(0, U64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(U64)
    with np.errstate(over="ignore"):
        return mix(mix(eight[:-8]) * U64(0x100000001B3) + eight[8:])


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """An order-dependent hash of several hash columns."""
    out = np.zeros(len(parts[0]), U64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * U64(0x100000001B3) + p)
    return out
