"""Exact dedup against a history, by a minimal perfect hash over its distinct digests.

The history's distinct digests are dealt by hash into buckets of bounded size. Each
bucket becomes one row of an index table: the perfect hash and, by slot, the full
digest, the winner's doc_id and the number of copies. A batch is first counted by
digest, so that thousands of copies are one row before anything is shuffled by
bucket; each distinct digest is then looked up in its bucket's hash, and the stored
digest is compared byte for byte. Members are repeats of the history; nonmembers
keep the group that they form among themselves.

Defined cases: a null text counts as empty; rows with a null doc_id never win
against others; every row of a repeated (doc_id, text) has the same verdict, and
``drop_repeats`` leaves one of them; an empty table gives an empty result; further
columns of the input pass ``drop_repeats`` and don't reach ``verdicts``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import own_names, plain_names, saved, text_or_empty
from recordloom.llm.perfect_hash import PerfectHash, as_words

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BUCKET_DIGESTS = 50_000
INDEX_SCHEMA = "bucket long, hash binary, digests binary, winners binary, copies binary, twins binary"
GROUPS = "digest binary, winner long, copies long, twins long"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with runs of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, WHITE_SPACE, " "), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(text_or_empty()).alias("digest"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: smallest doc_id, number of rows, rows with that doc_id."""
    by_id = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by(F.struct("doc_id", "n"), F.coalesce("doc_id", F.lit(2**63 - 1)))
    return by_id.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("copies")).select(
        "digest", F.col("first.doc_id").alias("winner"), "copies", F.col("first.n").alias("twins")
    )


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(-(2**63)).to_numpy().astype("<i8")


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index table of a history: one row per bucket."""

    def index(key, table):
        words = as_words(table["digest"].to_pylist())
        perfect = PerfectHash.build(words)
        at = np.argsort(perfect.slots(words))
        columns = [words[at].tobytes(), *(_numbers(table[c])[at].tobytes() for c in ("winner", "copies", "twins"))]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in (perfect.to_bytes(), *columns))],
                        names=["bucket", "hash", "digests", "winners", "copies", "twins"])

    return groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(index, INDEX_SCHEMA)


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """The groups of a batch with the history's winner and counts where the digest is a member, else nulls."""

    def look(_, mine, theirs):
        n = len(mine)
        member = np.zeros(n, dtype=bool)
        found = {c: np.zeros(n, dtype="<i8") for c in ("winners", "copies", "twins")}
        if n and len(theirs):
            words = as_words(mine["digest"].to_pylist())
            slots = PerfectHash.from_bytes(theirs["hash"][0].as_py()).slots(words)
            kept = np.frombuffer(theirs["digests"][0].as_py(), "<u8").reshape(-1, 4)
            member = (slots >= 0) & (kept[np.maximum(slots, 0)] == words).all(axis=1)
            for c in found:
                found[c] = np.frombuffer(theirs[c][0].as_py(), "<i8")[np.maximum(slots, 0)]
        none = ~member
        columns = [mine["digest"].combine_chunks(), mine["winner"], mine["copies"], mine["twins"]]
        columns += [pa.array(found["winners"], mask=none | (found["winners"] == -(2**63)))]
        columns += [pa.array(found[c], mask=none) for c in ("copies", "twins")] + [pa.array(member)]
        return pa.table(columns, names=["digest", "winner", "copies", "twins", "old_winner", "old_copies", "old_twins", "member"])

    mine = groups.withColumn("bucket", _bucket(buckets))
    schema = f"{GROUPS}, old_winner long, old_copies long, old_twins long, member boolean"
    return mine.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, schema)


def verdicts(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per distinct digest of both: digest, keep_id, group_size, twins (rows with the winner's id)."""
    old, new = saved(digest_groups(history), "history-digests"), saved(digest_groups(batch), "batch-digests")
    buckets = max(1, -(-max(old.count(), new.count()) // BUCKET_DIGESTS))
    seen = look_up(new, saved(build_index(old, buckets), "digest-index"), buckets)
    theirs, ours = F.coalesce("old_winner", F.lit(2**63 - 1)), F.coalesce("winner", F.lit(2**63 - 1))
    twins = F.when(theirs < ours, F.col("old_twins")).when(theirs > ours, F.col("twins")).otherwise(F.col("old_twins") + F.col("twins"))
    merged = seen.select(
        "digest",
        F.when(F.col("member"), F.least("old_winner", "winner")).otherwise(F.col("winner")).alias("keep_id"),
        (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size"),
        F.when(F.col("member"), twins).otherwise(F.col("twins")).alias("twins"),
    )
    before = old.select("digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), "twins")
    last = F.struct("group_size", "keep_id", "twins")  # the batch's row of a digest holds the history's copies too
    return before.unionAll(merged).groupBy("digest").agg(F.max_by(last, "group_size").alias("last")).select("digest", "last.*")


def exact_dedup(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per row of both: doc_id, keep_id, group_size, kept, text_sha256. Both need doc_id and text."""
    old, new = saved(digest_rows(history), "history-rows"), saved(digest_rows(batch), "batch-rows")
    found = saved(verdicts(old, new), "verdicts")  # no aggregate above it: the join can split a hot digest
    return old.unionAll(new).join(found, "digest").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of both that stay: of equal texts one row with the smallest doc_id."""
    old, new = saved(digest_rows(history), "history-rows"), saved(digest_rows(batch), "batch-rows")
    winners = saved(verdicts(old, new), "verdicts").select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"), F.col("twins").alias("__twins"))
    docs, names = plain_names(history.unionByName(batch), "doc_id", "text")
    on = (F.col("__text_digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
    found = docs.withColumn("__text_digest", text_digest(text_or_empty())).join(winners, on)
    single = found.filter("__twins = 1").select(*docs.columns)
    twins = found.filter("__twins > 1").dropDuplicates(["doc_id", "__text_digest"]).select(*docs.columns)
    return own_names(single.unionAll(twins), names)
