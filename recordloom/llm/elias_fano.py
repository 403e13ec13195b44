"""Elias-Fano coding of non-decreasing numbers, with select.

The low bits of each number are packed; the high parts are a bit vector in which the
i-th set bit lies at (high part + i). Every ``SAMPLE``-th set bit's place is kept, so
that one number costs a short popcount scan. About 2 + log2(universe / n) bits each.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256


def _popcounts(data: np.ndarray) -> np.ndarray:
    return np.bitwise_count(data).astype(np.int64)


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def _low(self, first: int, last: int) -> np.ndarray:
        k = self.low_bits
        a, b = first * k, last * k
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(k, dtype=np.uint64)
        return (bits.reshape(last - first, k).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, found from the nearest sample."""
        at, skip = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        first = int(self.high[byte]) & (0xFF << (at % 8))
        seen = np.cumsum(np.concatenate([[first.bit_count()], _popcounts(self.high[byte + 1 : byte + 1 + 2 * SAMPLE])]))
        while seen[-1] <= skip:  # a run of zeros longer than usual
            more = self.high[byte + len(seen) : byte + 3 * len(seen)]
            seen = np.concatenate([seen, seen[-1] + np.cumsum(_popcounts(more))])
        k = int(np.searchsorted(seen, skip, side="right"))
        left = skip - (int(seen[k - 1]) if k else 0)
        value = first if not k else int(self.high[byte + k])
        for _ in range(left):
            value &= value - 1
        place = 8 * (byte + k) + (value & -value).bit_length() - 1
        return ((place - i) << self.low_bits) | int(self._low(i, i + 1)[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, low, high = struct.unpack_from("<QQQQ", data)
        return cls(
            n, low_bits, np.frombuffer(data, np.uint8, low, 32), np.frombuffer(data, np.uint8, high, 32 + low),
            np.frombuffer(data, "<u8", -1, 32 + low + high),
        )
