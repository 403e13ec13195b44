"""Ranked lexical search: best-first over document intervals with range-maximum tables.

Documents are indexed in segments of bounded size, in the tasks that read them; no
posting is shuffled. A segment orders its documents by doc_id and has a posting list
per term, whose impacts (the score a document gains from one occurrence of the term in
a query) lie under a sparse table that gives the place of the maximum of any range.

A query starts with the interval of all documents of a segment. The maxima of its
terms' lists within an interval, summed, bound every score in it. The interval with the
largest bound is split at the document with its largest impact: that document is scored
and both sides go back with bounds of their own. The search ends when no bound can
enter the best ``k``. What a task has found in one segment holds as a bar in its next.

Queries are taken in blocks of a bounded number of terms, each block against all
documents; the terms of a block are all that travels to the tasks.

Scores are integers, see ``search``.

Defined cases: null and empty texts hold no terms and are never found; repeated rows,
among the documents and among the queries, count as rows of their own; a null doc_id
comes last among equal scores, a null item_id is carried; with an empty table there is
no result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recordloom.llm.common import saved, text_or_empty

BEST = 20
SEGMENT_DOCS = 4096
SEGMENT_POSTINGS = 1 << 20
BLOCK_TERMS = 200_000  # occurrences of terms in the queries of a block, which the driver sends to the tasks
SPLITS = 32  # intervals opened at a time
UNIT = 1_000_000_000
LAST = np.iinfo(np.int64).max  # stands for no doc_id

# Characters below U+0080 that end a term; capital letters A-Z count as small ones.
SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_counts(queries: DataFrame) -> DataFrame:
    """One row per query: row (any unique number), item_id, its distinct terms, how often each, and how many in all."""

    def count(batches):
        for batch in batches:
            found = [Counter(terms_of(t.as_py())) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["item_id"], pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), pa.array([len(c) for c in found], pa.int64())],
                ["row", "item_id", "terms", "times", "size"],
            )

    rows = queries.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(count, "row long, item_id long, terms array<binary>, times array<long>, size long")


SEGMENT = "doc_ids binary, sizes binary, terms binary, places binary, times binary, n_docs long, n_terms long, term_ids array<int>, frequencies array<long>"


def segments(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The index of the terms in ``vocabulary`` (numbers from 1): one row per segment."""

    def close(ids: list, sizes: list, hits: list) -> pa.RecordBatch:
        keys = np.array([LAST if i is None else i for i in ids], np.int64)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        owner = np.repeat(place, [len(h) for h in hits])
        flat = np.fromiter((t for h in hits for t in h), np.int64, len(owner))
        posting, times = np.unique(flat * len(ids) + owner, return_counts=True)
        terms, places = posting // len(ids), posting % len(ids)
        distinct, frequencies = np.unique(terms, return_counts=True)
        sizes = np.array(sizes, np.int64)
        packed = [keys[order], sizes[order], terms.astype(np.int32), places.astype(np.int32), times.astype(np.int32)]
        values = [pa.array([x.tobytes()], pa.binary()) for x in packed]
        values += [pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        values += [pa.array([distinct.astype(np.int32)], pa.list_(pa.int32())), pa.array([frequencies], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(values, ["doc_ids", "sizes", "terms", "places", "times", "n_docs", "n_terms", "term_ids", "frequencies"])

    def index(batches):
        number = vocabulary.get
        ids, sizes, hits, n = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                terms = terms_of(text.as_py())
                ids.append(doc_id)
                sizes.append(len(terms))
                hits.append([i for i in map(number, terms) if i])
                n += len(hits[-1])
                if len(ids) >= SEGMENT_DOCS or n >= SEGMENT_POSTINGS:
                    yield close(ids, sizes, hits)
                    ids, sizes, hits, n = [], [], [], 0
        if ids:
            yield close(ids, sizes, hits)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(index, SEGMENT)


@dataclass
class Query:
    row: int
    terms: np.ndarray  # numbers in the vocabulary
    times: np.ndarray


def lengths_norm(sizes: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A document's m: 100 for one of mean length, a quarter of it in proportion to the length."""
    if int(sizes.max(initial=0)) * 25 * docs < 2**62:
        return 75 + 25 * sizes * docs // terms
    return np.array([75 + 25 * int(n) * docs // terms for n in sizes], np.int64)


class Segment:
    """Posting lists of a segment, one after another, under one sparse table of maxima.

    ``before[t, d]`` counts the documents before ``d`` in the list of term ``t``, so the
    part of a list that lies in an interval of documents needs no search.
    """

    def __init__(self, row: dict, weights: np.ndarray, docs: int, terms: int):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        term, self.places = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["places"], np.int32)
        times = np.frombuffer(row["times"], np.int32).astype(np.int64)
        n = len(sizes)
        norm = lengths_norm(sizes, docs, terms)[self.places] if len(term) else np.empty(0, np.int64)
        self.impacts = weights[term] * (UNIT * times // (1000 * times + 12 * norm))
        present, first = np.unique(term, return_index=True)
        self.slot = np.zeros(len(weights), np.int64)  # the last slot is an empty list
        self.slot[:] = len(present)
        self.slot[present] = np.arange(len(present))
        self.offsets = np.append(first, len(term)).astype(np.int64)
        marks = np.zeros((len(present) + 1, n + 1), np.int32 if n > 30000 else np.int16)
        marks[np.repeat(np.arange(len(present)), np.diff(self.offsets)), self.places + 1] = 1
        self.before = np.cumsum(marks, axis=1, dtype=marks.dtype)
        level = np.arange(len(term), dtype=np.int32)
        self.best = [level]  # best[k][p]: place of the largest impact among 2**k postings from p on
        width = 1
        while 2 * width <= n and len(level) > width:
            a, b = level[:-width], level[width:]
            level = np.where(self.impacts[b] > self.impacts[a], b, a)
            self.best.append(level)
            width *= 2
        starts = np.cumsum([0, *map(len, self.best)])
        self.flat = np.concatenate(self.best) if len(term) else np.zeros(1, np.int32)
        self.starts = np.array(starts[:-1], np.int64)
        self.log = np.zeros(n + 2, np.int64)
        for i in range(2, n + 2):
            self.log[i] = self.log[i // 2] + 1

    def search(self, query: Query, best: list[tuple[int, int]], k: int) -> None:
        """Puts the segment's documents that belong there into ``best``, a heap of (score, -doc_id) of at most k."""
        slots = self.slot[query.terms]
        known = slots < len(self.offsets) - 1
        slots, times = slots[known], query.times[known]
        if not len(slots):
            return
        view = _View(self, slots)

        def enters(bound: int, doc_id: int) -> bool:
            return len(best) < k or (bound, -doc_id) > best[0]

        n = len(self.doc_ids)
        bound, split = view.bounds(times, np.array([0]), np.array([n]))
        frontier = [(-int(bound[0]), 0, n, int(split[0]))] if bound[0] > 0 else []
        while frontier:
            opened = []
            while frontier and len(opened) < SPLITS:
                interval = heapq.heappop(frontier)
                if not enters(-interval[0], int(self.doc_ids[interval[1]])):
                    if len(best) == k and -interval[0] < best[0][0]:
                        frontier = []  # all others are bounded by no more
                    continue
                opened.append(interval)
            if not opened:
                break
            found = np.array([x[3] for x in opened], np.int64)
            for doc, score in zip(self.doc_ids[found].tolist(), view.scores(times, found).tolist()):
                if score > 0 and enters(score, doc):
                    (heapq.heapreplace if len(best) == k else heapq.heappush)(best, (score, -doc))
            a = np.array([[x[1], x[3] + 1] for x in opened]).ravel()
            b = np.array([[x[3], x[2]] for x in opened]).ravel()
            a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            bound, split = view.bounds(times, a, b)
            for interval in zip((-bound).tolist(), a.tolist(), b.tolist(), split.tolist()):
                if interval[0] < 0 and enters(-interval[0], int(self.doc_ids[interval[1]])):
                    heapq.heappush(frontier, interval)


class _View:
    """A segment's lists of the terms of one query."""

    def __init__(self, segment: Segment, slots: np.ndarray):
        self.before = np.ascontiguousarray(segment.before[slots].T)
        self.base = segment.offsets[slots]
        self.segment = segment

    def bounds(self, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For document intervals [a, b): the sums of the maxima, and the documents with the largest one."""
        s = self.segment
        low, high = self.before[a], self.before[b].astype(np.int64)
        size = high - low
        some = size > 0
        k = s.log[size]
        at = s.starts[k] + self.base
        left = s.flat[np.where(some, at + low, 0)]
        right = s.flat[np.where(some, at + high - (1 << k), 0)]
        top = np.where(s.impacts[right] > s.impacts[left], right, left)
        gains = np.where(some, times * s.impacts[top], 0)
        return gains.sum(axis=1), s.places[top[np.arange(len(a)), gains.argmax(axis=1)]]

    def scores(self, times: np.ndarray, docs: np.ndarray) -> np.ndarray:
        held = self.before[docs].astype(np.int64)
        some = self.before[docs + 1] > held
        return np.where(some, times * self.segment.impacts[np.where(some, self.base + held, 0)], 0).sum(axis=1)


def _searched(index: DataFrame, queries: list[Query], weights: np.ndarray, docs: int, terms: int, k: int) -> DataFrame:
    """row, doc_id and score of the best documents of each query, k per task."""

    def search(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, weights, docs, terms)
                for query, found in zip(queries, best):
                    segment.search(query, found, k)
        found = [(q.row, -doc, score) for q, b in zip(queries, best) for score, doc in b]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["row", "doc_id", "score"])

    return index.select("doc_ids", "sizes", "terms", "places", "times").mapInArrow(search, "row long, doc_id long, score long")


def _block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.select("row", "terms", "times").collect()  # BLOCK_TERMS bounds them
    vocabulary: dict[bytes, int] = {}
    for r in rows:
        for t in r.terms:
            vocabulary.setdefault(bytes(t), len(vocabulary) + 1)
    index = saved(segments(docs, vocabulary), "segments")
    n, total = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    pairs = index.select(F.explode(F.arrays_zip("term_ids", "frequencies")).alias("x"))
    frequencies = np.zeros(len(vocabulary) + 1)
    for r in pairs.groupBy("x.term_ids").agg(F.sum("x.frequencies").alias("n")).collect():  # the terms of a block
        frequencies[r.term_ids] = r.n
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * frequencies + 1))).astype(np.int64)
    queries = [Query(r.row, np.array([vocabulary[bytes(t)] for t in r.terms], np.int64), np.array(r.times, np.int64)) for r in rows if r.terms]
    return saved(_searched(index, queries, weights, n, total, k), "found")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents for each query: item_id, rank (from 1), doc_id, score.

    ``docs`` needs doc_id and text, ``queries`` item_id and text. With N documents that
    hold a term, L terms in them, n terms in a document, of which tf are the term, and df
    documents that hold it, a document's m is 75 + (25 n N) div L, a term's weight
    w = floor(1000 ln((2N + 2) / (2 df + 1))), and each occurrence of the term in the query
    gives w ((1000000000 tf) div (1000 tf + 12 m)). Equal scores are ordered by doc_id.
    """
    counted = saved(term_counts(queries), "queries")
    total = counted.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS) or 1
    found = [_block(docs, counted.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i), k) for i in range(blocks)]
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionAll(x)
    order = [F.desc("score"), F.asc("doc_id")]
    some = rows.withColumn("part", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= k)
    named = ranked.join(counted.select("row", "item_id"), "row")
    return named.select("item_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")
