"""Shingles and ProbMinHash signatures, in numpy over blocks of documents.

Every shingle sends arrivals of a Poisson process whose rate is its weight to random
places of the signature; a place keeps the shingle that arrives first. Two documents
agree in a place with their probability Jaccard similarity. A shingle stops as soon
as its next arrival comes after every place of its document has an earlier one.
"""

from __future__ import annotations

import numpy as np
import xxhash

from recordloom.llm.common import BoundedTable

SHINGLE_WORDS = 5
BANDS, ROWS = 24, 6
PLACES = BANDS * ROWS
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(BoundedTable):
    def make(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode())


def new_word_hashes() -> dict:
    return _WordHashes()


def shingles(text: str, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, sorted, and their weights.

    Words are runs of non-space characters in lower case. A shingle is five words; a
    text of one to four words is one shingle. All weights are one, so the similarity
    that signatures estimate is the plain Jaccard similarity, by which links are defined.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0)
    hashed = np.array([hashes[w] for w in words], dtype=np.uint64)
    span = min(SHINGLE_WORDS, n)
    total = np.zeros(n - span + 1, np.uint64)
    for i in range(span):
        total = total * GOLDEN + hashed[i : n - span + 1 + i]
    found = np.unique(mixed(total + np.uint64(span)))
    return found, np.ones(len(found))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """ProbMinHash signatures of a block: one row of PLACES elements per document."""
    earliest = np.full(documents * PLACES, np.inf)
    kept = np.zeros(documents * PLACES, dtype=np.uint64)
    element, rate, doc, time = elements, weights, owner, np.zeros(len(elements))
    step = 0
    while len(element):
        step += 1
        with np.errstate(over="ignore"):
            drawn = mixed(element + np.uint64(2 * step) * GOLDEN)
            place = mixed(element + np.uint64(2 * step + 1) * GOLDEN) % np.uint64(PLACES)
        time = time - np.log((drawn >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        at = doc * PLACES + place.astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        kept[at[won]] = element[won]
        open_ = time < earliest.reshape(documents, PLACES).max(axis=1)[doc]
        element, rate, doc, time = element[open_], rate[open_], doc[open_], time[open_]
    return kept.reshape(documents, PLACES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per document and band; the band is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mixed(key * GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def set_key(elements: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(elements.tobytes())
