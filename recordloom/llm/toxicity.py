"""Toxic passages by maximum-scoring segments over token log-odds.

Learning. On a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the
smallest seeded hash) words are counted by class, and with them their beginnings of three to eight letters, which stand for
inflected and derived forms. A word's score is that of its most telling feature: the log-odds
ratio between toxic and clean under an informative Dirichlet prior (the background
share, plus a floor), shrunk towards 0 by its standard error, less a drift that makes
the expected score of clean text negative.

Scoring. One linear scan of a text finds all maximal-scoring segments. Under clean
text the best segment follows an extreme-value law: with rate ``lam``, at which clean
tokens' exponentiated scores average 1 (with a small part of toxic ones mixed in), and scale ``k``, fitted to the clean texts of
the sample, a segment of score S in n words has the E-value k n exp(-lam S). The
evidence of a document is what its segments have beyond the score expected by
chance, summed; a logistic curve fitted on the sample turns it into a probability.

Defined cases: null and empty texts have no words and get the score of no evidence;
without examples of both classes every score is the share of toxic labels, 0 without
labels; a doc_id labelled more than once is toxic if any label says so; null labels
and null doc_ids teach nothing; repeated rows are scored alike; further columns pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from recordloom.llm.common import BoundedTable, own_names, plain_names, saved, text_or_empty

SAMPLE_ROWS = 20_000
MODEL_WORDS = 50_000
PRIOR_TOKENS = 1000.0
PRIOR_FLOOR = 0.5
SHRINK = 2.33
DRIFT = 0.1
SIGNIFICANT = 0.05
THRESHOLD = 0.7
STEMS = range(3, 9)
TOXIC_BACKGROUND = 0.01
WORD = re.compile(r"\w+")
EULER = 0.5772156649015329


@dataclass
class Model:
    scores: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0
    constant: float | None = None

    def probability(self, evidence: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * math.log1p(evidence)))))


def held_out():
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score), in linear time.

    Only positive scores start segments; what lies between them enters by cumulative
    sums. Each candidate knows the nearest earlier one with a smaller left sum.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # left sum, right sum, first, last, earlier candidate
    for p in positive.tolist():
        left, right, first = float(sums[p]), float(sums[p + 1]), p
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= left:
                at = found[at][4]
            if at < 0 or found[at][1] >= right:
                break
            left, first, back = found[at][0], found[at][2], found[at][4]
            del found[at:]
            at = back
        found.append([left, right, first, p, at])
    return [(first, last, right - left) for left, right, first, last, _ in found]


def features(word: str) -> list[str]:
    """The word and, for what is shared by inflected and derived forms, its beginnings."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class WordScores(BoundedTable):
    """Scores by word, filled as words come: that of the feature which tells most; bounded."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def make(self, word: str) -> float:
        return max((self.scores.get(f, 0.0) for f in features(word)), key=abs) - DRIFT


def word_scores(text: str, scores: WordScores) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(scores.__getitem__, words), float, len(words))


def passages(text: str, model: Model, scores: WordScores) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Number of words, and each segment's first and last word, score and E-value."""
    values = word_scores(text, scores)
    n = max(1, len(values))
    return n, [(a, b, s, model.k * n * math.exp(-model.lam * s)) for a, b, s in maximal_segments(values)]


def evidence(segments: list[tuple[int, int, float, float]]) -> float:
    """Sum of what the segments have beyond chance, in natural units."""
    return sum(max(0.0, -math.log(max(e, 1e-300))) for _, _, _, e in segments)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of the bounded sample of labelled rows that may teach."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("text"))
    return saved(texts.join(F.broadcast(chosen), "__id").select("text", "toxic"), "toxic-sample")  # at most sample_rows short rows


def feature_scores(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the features that tell the classes apart, by the number of texts with a word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    counts = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    stems = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    named = counts.select("t", "c", F.explode(F.array_compact(F.array("word", *stems))).alias("feature"))
    counts = saved(named.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxic-features")
    plain = counts.filter(~F.endswith("feature", F.lit("*")))
    nt, nc, kinds = (float(x or 0) for x in plain.agg(F.sum("t"), F.sum("c"), F.count(F.lit(1))).first())
    if not nt or not nc:
        return {}
    prior = F.lit(PRIOR_TOKENS) * (F.col("t") + F.col("c")) / (nt + nc) + PRIOR_FLOOR
    total = PRIOR_TOKENS + PRIOR_FLOOR * kinds
    t, c = F.col("t") + prior, F.col("c") + prior
    ratio = F.log(t / F.greatest(nt + total - t, F.lit(1.0))) - F.log(c / F.greatest(nc + total - c, F.lit(1.0)))
    sure = F.greatest(F.abs(ratio) - SHRINK * F.sqrt(1 / t + 1 / c), F.lit(0.0)) * F.signum(ratio)
    telling = counts.select("feature", sure.alias("score")).filter("score != 0").orderBy(F.desc(F.abs("score")), "feature").limit(MODEL_WORDS)
    return {r.feature: r.score for r in telling.collect()}


def rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of: mean of exp(lam * score) = 1 over a distribution of token scores."""
    low, high = 0.0, 20.0
    for _ in range(60):
        lam = (low + high) / 2
        mean = float((shares * np.exp(np.minimum(lam * values, 500))).sum())
        low, high = (lam, high) if mean < 1 else (low, lam)
    return max(lam, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and non-negative slope of a ridge logistic regression, by Newton steps."""
    design, weights = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * weights
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), gradient)
        weights = weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), max(0.0, float(weights[1]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns words, extreme-value law and calibration; ``sample_rows`` bounds all that reaches the driver."""
    rows = training_rows(docs, labels, sample_rows)
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    scores = feature_scores(rows)
    if not scores:
        return Model({}, constant=float(toxic or 0) / n if n else 0.0)

    def scan(batches):
        kept = WordScores(scores)
        for batch in batches:
            out = []
            for text in batch["text"]:
                values = word_scores(text.as_py(), kept)
                steps, counts = np.unique(np.round(values, 2), return_counts=True)
                out.append((len(values), [s for _, _, s in maximal_segments(values)], steps, counts))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch["toxic"], *columns], ["toxic", "n", "segments", "steps", "counts"])

    scanned = saved(rows.mapInArrow(scan, "toxic int, n long, segments array<double>, steps array<double>, counts array<long>"), "toxic-scan")
    weight = F.when(F.col("toxic") == 1, F.lit(TOXIC_BACKGROUND)).otherwise(F.lit(1.0))
    pairs = scanned.select(weight.alias("w"), F.explode(F.arrays_zip("steps", "counts")).alias("x"))
    steps = pairs.groupBy("x.steps").agg(F.sum(F.col("w") * F.col("x.counts")).alias("n")).collect()  # one row per hundredth
    shares = np.array([r.n for r in steps])
    lam = rate(np.array([r.steps for r in steps]), shares / shares.sum())
    model = Model(scores, lam)
    found = scanned.select("toxic", "n", "segments").collect()  # at most sample_rows rows
    tops = [lam * max(r.segments) - math.log(r.n) for r in found if not r.toxic and r.segments]
    model.k = math.exp(min(50.0, max(-50.0, float(np.mean(tops)) - EULER))) if tops else 1.0
    x = np.array([math.log1p(evidence([(0, 0, s, model.k * max(1, r.n) * math.exp(-lam * s)) for s in r.segments])) for r in found])
    model.intercept, model.slope = _logistic(x, np.array([float(r.toxic) for r in found]))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with __score, __passages (significant ones) and __top (best segment score)."""
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType()), StructField("__passages", IntegerType()), StructField("__top", DoubleType())])

    def score(batches):
        kept = WordScores(model.scores)
        for batch in batches:
            out = []
            for text in batch["text"]:
                _, found = passages(text.as_py() or "", model, kept)
                out.append((model.probability(evidence(found)), sum(e < SIGNIFICANT for _, _, _, e in found), max((s for _, _, s, _ in found), default=0.0)))
            columns = list(zip(*out)) or [(), (), ()]
            added = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "__score", "__passages", "__top"])

    return docs.mapInArrow(score, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages, top_score."""
    return scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("__passages").alias("passages"), F.col("__top").alias("top_score"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    plain, names = plain_names(docs, "text")
    return own_names(scored(plain, fit(docs, labels)).filter(F.col("__score") < THRESHOLD), names)
