"""Minimal perfect hashing of distinct digests, in numpy.

Levels of bit arrays: a level's bit is set where exactly one of the remaining keys
falls; the others go on to the next level. A key's slot is the rank of its bit, so
``n`` keys have the slots 0 to n-1.
"""

from __future__ import annotations

import numpy as np

BITS_PER_KEY = 2
LEVELS = 64


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = words[:, 0] + words[:, 1] * np.uint64(2 * level + 1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= (h >> np.uint64(29)) + words[:, 2]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def as_words(digests: list[bytes]) -> np.ndarray:
    """32-byte digests as rows of four unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, rest = [], words
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("the digests are not distinct")
            size = -(-BITS_PER_KEY * len(rest) // 64) * 64
            places = _places(rest, len(levels), size)
            alone = np.bincount(places, minlength=size)[places] == 1
            bits = np.zeros(size, dtype=bool)
            bits[places[alone]] = True
            levels.append(bits)
            rest = rest[~alone]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that are surely not members. Other strangers get any slot."""
        found = np.full(len(words), -1, dtype=np.int64)
        open_ = np.arange(len(words))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            places = _places(words[open_], level, len(bits))
            hit = bits[places]
            found[open_[hit]] = ranks[places[hit]]
            open_ = open_[~hit]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<u8").tobytes()
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", n, 8).astype(int)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels)
