"""Mixing sources by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The
exponent is found by bisection on [0, 1] so that the entropy of the weights, or the
number of times that the most repeated source is read, meets its target; the sums
that this needs are Spark aggregates over the table of sources.

The budget in tokens is given, or the smallest one at which every source is read at
least once. A source's budget is its weight times the whole. A source is read in
epochs; each epoch is a permutation of its own: hashed blocks in hashed order, hashed
order within blocks. The last epoch ends where the budget does, in whole tokens and
whatever the size of the source. Prefix sums run over
blocks first and within blocks then, so no source, however large, is in one task.

A drawn document's place in its source's sequence, as a share of the source's
budget, tells its mix block: every mix block holds every source by its weight, and is
permuted by a seeded hash.

Defined cases: a null source is the empty one; a null text has no words; every
document counts at least one token; rows with the same doc_id are one document, their
tokens add up and they are drawn together;
an empty table gives an empty result; further columns are ignored, or carried by
``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm.common import own_names, plain_names, saved, text_or_empty

BLOCK_TOKENS = 1_000_000
STEPS = 16
ROUNDS = 8
ROUNDING = 1e-3  # tokens by which a budget may miss a whole number


def words_of() -> Column:
    """A document's tokens for shares: its runs of non-space characters, one at least."""
    return F.greatest(F.regexp_count(text_or_empty(), F.lit(r"\S+")), F.lit(1)).cast("long")


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent for the target, from a table with the column ``tokens`` per source.

    Entropy (in nats) falls and the largest repetition grows as the exponent goes from
    1 to 0, both steadily. Each round evaluates a grid of exponents in one aggregate
    and keeps the cell in which the target lies: a bisection with several cuts. A
    target out of reach gives the nearest end.
    """
    total, most, least = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if total is None:
        return 1.0
    share = F.col("tokens") / F.lit(total)

    def too_flat(power: float, z: float, slope: float) -> bool:
        if entropy is not None:
            return math.log(z) - power * slope / z > entropy
        whole = budget if budget is not None else most / ((most / total) ** power / z)
        return whole * (least / total) ** power / z / least > repeats

    low, high = 0.0, 1.0  # low is too flat or an end, high is not
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        sums = sources.agg(*[F.sum(F.pow(share, F.lit(a))) for a in grid], *[F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in grid]).first()
        flat = [too_flat(a, sums[i], sums[STEPS + 1 + i]) for i, a in enumerate(grid)]
        if not flat[0]:
            return low
        if flat[-1]:
            return high
        at = flat.index(False)
        low, high = grid[at - 1], grid[at]
    return high


def weighted(rows: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """source, tokens, weight, budget of each source; ``rows`` has source and tokens per document."""
    sources = saved(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    power = exponent(sources, entropy, repeats, budget)
    raw = F.pow(F.col("tokens") / F.lit(float(sources.agg(F.sum("tokens")).first()[0] or 1)), F.lit(power))
    z, largest = sources.agg(F.sum(raw), F.max(F.col("tokens") / raw)).first()
    whole = budget if budget is not None else (largest or 0.0) * (z or 1.0)
    named = sources.withColumn("weight", raw / F.lit(z or 1.0))
    return saved(named.withColumn("budget", F.greatest(F.col("weight") * F.lit(whole), F.lit(0.0 if budget is not None else 1.0) * F.col("tokens"))), "weights")


def draws(rows: DataFrame, sources: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every drawing of a document: doc_id, source, tokens, epoch, mix_block, slot, weight."""
    limit = F.ceil(F.col("budget") - ROUNDING)
    spec = sources.select("source", F.col("tokens").alias("all"), "weight", "budget", limit.alias("limit"))
    copies = rows.join(spec, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("greatest((limit - 1) div all, 0)").cast("int"))))
    blocks = F.greatest(F.ceil(F.col("all") / F.lit(block_tokens)), F.lit(1))
    copies = copies.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), blocks)).withColumn("turn", F.xxhash64(F.lit(seed + 1), "doc_id", "epoch"))
    copies = saved(copies, "copies")
    sums = copies.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("block_tokens"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed + 2), "source", "epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("block_tokens").over(order), F.lit(0))).drop("block_tokens")
    within = Window.partitionBy("source", "epoch", "block").orderBy("turn", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["source", "epoch", "block"])
    start = F.col("epoch") * F.col("all") + F.col("before") + F.col("inside")
    drawn = placed.withColumn("start", start).filter(F.col("start") < F.col("limit"))
    whole = sources.agg(F.sum("budget")).first()[0] or 0
    mix_blocks = max(1, math.ceil(whole / block_tokens))
    drawn = drawn.withColumn("mix_block", F.least(F.floor(F.col("start") / F.col("budget") * mix_blocks), F.lit(mix_blocks - 1)).cast("long"))
    slot = F.row_number().over(Window.partitionBy("mix_block").orderBy("turn", "doc_id", "epoch")) - 1
    return drawn.withColumn("slot", slot.cast("long")).select("doc_id", "source", "tokens", "epoch", "mix_block", "slot", "weight")


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The drawings of a mix of all documents: doc_id, source, tokens, epoch, mix_block, slot, weight."""
    each = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words_of().alias("tokens"))
    rows = saved(each.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")), "token-counts")
    return draws(rows, weighted(rows, entropy, repeats, budget), seed)


def mixed_documents(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as it is drawn, with their own columns."""
    drawn = mix(docs.select("doc_id", "source", "text"), entropy, repeats, budget, seed)
    times = saved(drawn.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__drawn")), "drawn")
    plain, names = plain_names(docs, "doc_id")
    found = plain.join(times, F.col("doc_id").eqNullSafe(F.col("__id")))
    return own_names(found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__drawn")))), names)
