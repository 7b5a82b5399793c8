"""Vectorised words and rolling hashes over Arrow string columns.

A word is a maximal run of bytes outside the six ASCII white-space characters, so words can be cut on UTF-8 bytes.
All hashes are 64-bit, depend on content only, and are equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = stream(11, 256)
LETTER[SPACE] = 0
LOWER_LETTER = LETTER.copy()
LOWER_LETTER[65:91] = LETTER[97:123]


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[U(1)], np.cumprod(np.full(size - 1, b, U))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def ranges(hashes: np.ndarray):
    """A function of arrays of bounds a, b: the running (Karp-Rabin) hash of hashes[a:b], from prefix sums."""
    up, down = _WORDS.get(len(hashes) + 1)
    total = np.concatenate([[U(0)], np.cumsum(hashes * up[:-1])])
    return lambda a, b: mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


@dataclass
class Words:
    """Words of a run of documents: byte bounds, hashes, and for document d the word range first[d]:first[d + 1]."""

    buf: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether those lie within one document."""
        m = len(self.hashes)
        out, ok = np.zeros(m, U), np.zeros(m, bool)
        if m >= n:
            up, down = _WORDS.get(m)
            total = np.concatenate([[U(0)], np.cumsum(self.hashes * up)])
            out[: m - n + 1] = mix((total[n:] - total[:-n]) * down[: m - n + 1] + U(n))
            ends = np.repeat(self.first[1:], np.diff(self.first))
            ok = np.arange(m) + n <= ends
        return out, ok

    def ranges(self):
        """A function of arrays of bounds a, b: the hash of the words a:b."""
        return ranges(self.hashes)

    def range_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranges()(a, b)


def cut(buf: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents buf[bounds[d]:bounds[d + 1]]; lower: A-Z count as a-z."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(buf, bounds, z, z, np.zeros(0, U), np.zeros(len(bounds), np.int64))
    solid = ~SPACE[buf]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    head[inner] = solid[inner]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    tail[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _BYTES.get(n)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum((LOWER_LETTER if lower else LETTER)[buf] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return Words(buf, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))


def pieces(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column of about ``size`` bytes (one row at least): low, high, bytes, bounds.  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        high = min(high, len(column))
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
