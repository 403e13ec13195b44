"""Counting greedy word pieces with a linear longest-match automaton.

The vocabulary is a trie. Every node knows by failure links where matching goes on
when no edge fits, and how many pieces that step has completed; so a word is read
once, character by character, and only numbers are added. A word that cannot be
covered by pieces is one unknown token, as in word-piece models.

Words are runs of letters, digits and underscores in lower case, and single other
characters; white space separates.

Defined cases: null and empty texts have no tokens; repeated rows are counted alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import BoundedTable, text_or_empty, worker_holds

WORD = re.compile(r"\w+|[^\w\s]")
NOWHERE = -1


class LongestMatch:
    """``initial`` pieces start a word, ``following`` ones continue it."""

    def __init__(self, initial: set[str], following: set[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0: start of a word, node 1: within a word
        ends = {}
        for root, pieces in ((0, initial), (1, following)):
            for piece in filter(None, pieces):
                node = root
                for ch in piece:
                    node = self.edges[node].setdefault(ch, len(self.edges))
                    if node == len(self.edges):
                        self.edges.append({})
                ends[node] = True
        self.fail = [NOWHERE] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for ch, child in self.edges[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at != NOWHERE and ch not in self.edges[at]:
                    at, popped = self.fail[at], popped + self.pops[at]
                if at != NOWHERE:
                    self.fail[child], self.pops[child] = self.edges[at][ch], popped
        self.at_end = [self._finish(node) for node in range(len(self.edges))]

    def _finish(self, node: int) -> int:
        """Pieces completed from a node to the end of the word; NOWHERE if it cannot be completed."""
        count = 0
        while node != 1:
            if self.fail[node] == NOWHERE:
                return NOWHERE
            node, count = self.fail[node], count + self.pops[node]
        return count

    def count(self, word: str) -> int:
        """Number of pieces of a word; NOWHERE if pieces cannot cover it."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for ch in word:
            while (found := edges[node].get(ch)) is None:
                total += pops[node]
                node = fail[node]
                if node == NOWHERE:
                    return NOWHERE
            node = found
        end = self.at_end[node]
        return NOWHERE if end == NOWHERE else total + end


def sentencepiece_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Initial and following pieces of a sentencepiece model: a leading U+2581 marks the start of a word."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p[1:] for p in plain if p[0] == "▁"}, {p for p in plain if "▁" not in p}


class _Counts(BoundedTable):
    """Tokens, words and unknown words of a chunk without spaces, as three 64-bit fields of one number."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def make(self, chunk: str) -> int:
        found = [self.automaton.count(w) for w in WORD.findall(chunk)]
        value = (sum(n if n >= 0 else 1 for n in found), len(found), sum(n < 0 for n in found))
        packed = value[0] | value[1] << 64 | value[2] << 128
        return packed


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_words, n_unknown. ``vocabulary`` is a sentencepiece model file."""

    def count(batches):
        counts = worker_holds(f"longest match {vocabulary}", lambda: _Counts(LongestMatch(*sentencepiece_vocabulary(vocabulary))))
        field = (1 << 64) - 1
        for batch in batches:
            sums = [sum(map(counts.__getitem__, text.as_py().lower().split())) for text in batch["text"]]
            columns = [pa.array([s >> shift & field for s in sums], pa.int64()) for shift in (0, 64, 128)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_tokens", "n_words", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long, n_words long, n_unknown long")
