"""Periodic stretches of texts, by uniting suffix classes in order of falling LCP.

The words of a text are numbered; its suffixes are sorted by prefix doubling, and
neighbours in that order are joined by edges that weigh what they share (LCP). A
Kruskal pass takes the edges from the heaviest down and unites the classes of both
ends with union-find; each class keeps its positions in order, and the smaller one is
put into the larger. Two positions that become neighbours there at a distance of at
most the LCP start the same ``distance`` words again: they seed a run. As the weight is
exactly what both share, the run cannot be longer on the right, and the seed at its
leftmost position gives it whole.

A run has the smallest period q, at least ``max(LEAST_WORDS, 2 * q)`` words, and cannot
be extended. So both positions of a seed share at least ``LEAST_WORDS / 2`` words: texts
in which no such sequence of words repeats are told apart first, many texts at a time.

Defined cases: null and empty texts have no words and no runs; repeated rows and null
ids are documents of their own; an empty table gives an empty result; further columns
are ignored. A text of any length is one task's work, with some 100 bytes a word.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_WORDS = 12
LEAST_SHARED = LEAST_WORDS // 2  # a run of LEAST_WORDS words and period q <= LEAST_WORDS / 2 shares that much with itself
GROUP_WORDS = 250_000
GROUP_TEXTS = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start:bigint,length:bigint,period:bigint>"
WHITE = r"[^\x20\x09-\x0D]+"  # a word


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def suspects(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of several texts, given one after another, hold LEAST_SHARED equal words in a row twice.

    Sequences are compared by a 44-bit hash beside the text's number: a text may be
    suspected wrongly, but none is missed.
    """
    span = len(words) - LEAST_SHARED + 1
    if span < 2:
        return np.empty(0, np.int64)
    total = np.zeros(span, np.uint64)
    words = words.astype(np.uint64) + np.uint64(1)
    for i in range(LEAST_SHARED):
        total = (total ^ words[i : i + span]) * MIX
        total ^= total >> np.uint64(29)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    inside = owner[:span] == owner[LEAST_SHARED - 1 :]
    keys = (owner[:span].astype(np.uint64) << np.uint64(44) | total >> np.uint64(20))[inside]
    keys.sort()
    return np.unique((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)).astype(np.int64))


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many words each shares with the next one."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    while int(ranks[-1].max()) + 1 < n:
        step, rank = 1 << (len(ranks) - 1), ranks[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        ranks.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 2, -1, -1):  # all differ in the last ranks
        x, y = a + shared, b + shared
        both = np.maximum(x, y) < n
        equal = both & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        shared += equal.astype(np.int64) << k
    return order, shared


def seeds(order: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of positions that become neighbours in their class at a distance up to the LCP."""
    edges = np.flatnonzero(shared >= LEAST_SHARED)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    parent = {int(e): int(e) for x in (edges, edges + 1) for e in x}
    members = {e: [p] for e, p in zip(parent, order[np.fromiter(parent, np.int64, len(parent))].tolist())}

    def root(e: int) -> int:
        while parent[e] != e:
            parent[e] = e = parent[parent[e]]
        return e

    found = []
    for e, lcp in zip(edges.tolist(), shared[edges].tolist()):
        a, b = root(e), root(e + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        parent[b] = a
        large, small = members[a], members.pop(b)
        last = -1  # the position of the smaller class put in before
        for i, p in enumerate(small):
            at = bisect(large, p)
            if at and large[at - 1] != last and p - large[at - 1] <= lcp:
                found.append((large[at - 1], p - large[at - 1], lcp))
            if at < len(large) and large[at] - p <= lcp and (i + 1 == len(small) or small[i + 1] > large[at]):
                found.append((p, large[at] - p, lcp))
            large.insert(at, p)
            last = p
    return found


def runs_of(words: np.ndarray) -> np.ndarray:
    """All runs of numbered words: a row of start, length and period each, by start, then period."""
    none = np.empty((0, 3), np.int64)
    if len(words) < LEAST_WORDS:
        return none
    found = np.array(seeds(*suffixes(words)), np.int64).reshape(-1, 3)
    start, period, lcp = found.T
    length = period + lcp
    leftmost = (start == 0) | (words[start - 1] != words[start - 1 + period])
    kept = np.column_stack([start, length, period])[leftmost & (length >= LEAST_WORDS)]
    return kept[np.lexsort((kept[:, 2], kept[:, 0]))] if len(kept) else none


def without_repeats(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def with_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length and period in words, by
    start, then period) and collapsed, its words without those that runs repeat."""

    def one_group(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers = _Numbers()
        sizes = np.array([len(t) for t in texts], np.int64)
        numbered = np.fromiter((n for t in texts for n in map(numbers.__getitem__, t)), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        runs = [np.empty((0, 3), np.int64)] * len(texts)
        for i in suspects(numbered, sizes).tolist():
            runs[i] = runs_of(numbered[ends[i] - sizes[i] : ends[i]])
        counts = np.cumsum([0, *map(len, runs)])
        flat = np.concatenate(runs)
        items = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)
        collapsed = pa.array([without_repeats(t, r) for t, r in zip(texts, runs)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    def find(batches):
        for batch in batches:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids.append(doc_id)
                texts.append(text.as_py().split())  # bytes: splits at the six ASCII blanks only
                n += len(texts[-1])
                if n >= GROUP_WORDS or len(ids) >= GROUP_TEXTS:
                    yield one_group(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield one_group(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(find, f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth text (by the CRC-32 h of its doc_id in decimals) periodic from
    a word on: with n words and g = h div 10, words from a = g mod n on repeat the p = 1 + (n - a)
    div (3 + g mod 8) words there. A row without doc_id stays as it is."""
    h = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WHITE), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    chosen = chosen.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    chosen = chosen.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(1 + (n - a) div p as int))), 1, n - a)")
    joined = F.array_join(F.concat(F.expr("slice(words, 1, a)"), again), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), joined).otherwise(F.col("text").cast("string")).alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """The longest run, and digests of all runs and of the collapsed text, per row of ``with_runs``."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    n = F.size("runs")
    rows = found.withColumns({"best": best, "lines": F.when(n > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))})
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
