"""Elias-Fano codes of non-decreasing integers, with a sampled select structure.

Each of n values below u keeps its low bits as they are, floor(log2(u / n)) of them, and its
high bits in unary: bit (high + i) of the upper vector is set for value i. Together that takes
about n * (2 + log2(u / n)) bits. ``select`` finds the i-th set bit from the position of every
``STEP``-th one, so one value is read without unpacking the others.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 64
_HEAD = struct.Struct("<QQB")


def encode(values: np.ndarray) -> bytes:
    """Bytes of non-decreasing unsigned ``values``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0)
    top = int(values[-1])
    low_bits = max(0, (top // n).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    upper = np.zeros(int(high[-1]) + n, np.uint8)
    upper[high + np.arange(n)] = 1
    low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = np.flatnonzero(upper)[::STEP]
    wide = "<u4" if len(upper) < 1 << 32 else "<u8"
    return b"".join([
        _HEAD.pack(n, len(upper), low_bits),
        ones.astype(wide).tobytes(),
        np.packbits(upper, bitorder="little").tobytes(),
        np.packbits(low.ravel(), bitorder="little").tobytes(),
    ])


class EliasFano:
    """Reads what :func:`encode` wrote."""

    def __init__(self, raw: bytes):
        self.n, self.upper_bits, self.low_bits = _HEAD.unpack_from(raw)
        at = _HEAD.size
        n_ones = -(-self.n // STEP)
        wide = "<u4" if self.upper_bits < 1 << 32 else "<u8"
        self.ones = np.frombuffer(raw, wide, n_ones, at)
        at += self.ones.nbytes
        self.upper = np.frombuffer(raw, np.uint8, -(-self.upper_bits // 8), at)
        at += self.upper.nbytes
        self.low = np.frombuffer(raw, np.uint8, -(-self.n * self.low_bits // 8), at)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes()
        return (int.from_bytes(part, "little") >> first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value ``i``: a jump to the sampled one before it, then a look at few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.ones[i // STEP])
        left = i % STEP
        at = start // 8
        byte = int(self.upper[at]) >> (start % 8) << (start % 8)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.upper[at])
        for _ in range(left):
            byte &= byte - 1
        position = at * 8 + (byte & -byte).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little", count=self.upper_bits))
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits)
        return high | bits.reshape(self.n, self.low_bits) @ (1 << np.arange(self.low_bits, dtype=np.int64))
