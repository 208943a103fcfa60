"""Wavelet matrix: a sequence of small integers as succinct bit planes.

Level by level, from the highest bit down, the values are split stably into
those with bit 0 and those with bit 1.  Each plane is stored as packed 64-bit
words plus a running count of ones for each word, so ``rank`` costs one popcount
and ``select`` a binary search.  All operations take arrays of positions.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WMX1"


class Plane:
    """One bit plane of n bits."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int64)

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(bits) // 64) * 8 + 8, np.uint8)
        padded[: len(packed)] = packed
        return cls(padded.view(np.uint64), len(bits))

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position (0 to n)."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of that value; all must exist."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            ones = self.rank1(middle + 1)
            enough = (ones if bit else middle + 1 - ones) > k
            high, low = np.where(enough & (low < high), middle, high), np.where(~enough & (low < high), middle + 1, low)
        return low


class WaveletMatrix:
    """A read-only sequence of integers below 2**levels."""

    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)
        self.zeros = [n - p.ones for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        if len(values) and (int(values.max()) >> levels or int(values.min()) < 0):
            raise ValueError(f"values need more than {levels} bits")
        # The narrowest type: sixteen bits hold most vocabularies.
        planes, current = [], np.asarray(values).astype(np.min_scalar_type((1 << levels) - 1))
        for level in range(levels - 1, -1, -1):
            bits = (current & current.dtype.type(1 << level)) != 0
            planes.append(Plane.of(bits))
            current = np.concatenate([np.compress(~bits, current), np.compress(bits, current)])
        return cls(planes, len(values))

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(at).astype(bool)
            ones = plane.rank1(at)
            out = (out << 1) | bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among the symbol's places on the last level."""
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            ones = plane.rank1(at)
            at = np.where(bit, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        symbol, at = np.asarray(symbol, np.int64), np.asarray(at, np.int64)
        return self.descend(symbol, at) - self.descend(symbol, np.zeros_like(at))

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.n]))[0])

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) occurrence of a symbol."""
        k = np.asarray(k, np.int64)
        at = self.descend(np.full(len(k), symbol, np.int64), np.zeros(len(k), np.int64)) + k
        for level in range(self.levels - 1, -1, -1):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            at = self.planes[level].select(bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol)))

    def values(self) -> np.ndarray:
        """The whole sequence: the splits undone from the last level up."""
        out = np.zeros(self.n, np.min_scalar_type((1 << self.levels) - 1))
        for level in range(self.levels - 1, -1, -1):
            bits, zeros = self.planes[level].bits(), self.zeros[level]
            # Values in this level's order from the order after its split.
            back = np.empty_like(out)
            back[np.flatnonzero(~bits)] = out[:zeros]
            back[np.flatnonzero(bits)] = out[zeros:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = back
        return out

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=3)
        blocks = [pack.compress(p.words.tobytes()) for p in self.planes]
        head = _MAGIC + struct.pack("<QI", self.n, self.levels) + struct.pack(f"<{self.levels}Q", *map(len, blocks))
        return head + b"".join(blocks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        data = memoryview(data)
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, levels = struct.unpack_from("<QI", data, 4)
        sizes = struct.unpack_from(f"<{levels}Q", data, 16)
        at, planes, unpack = 16 + 8 * levels, [], zstandard.ZstdDecompressor()
        for size in sizes:
            words = np.frombuffer(unpack.decompress(data[at : at + size]), np.uint64)
            planes.append(Plane(words, n))
            at += size
        return cls(planes, n)
