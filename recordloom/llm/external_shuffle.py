"""Sharding by a two-pass external shuffle.

First pass: a seeded hash of the id scatters the records uniformly into buckets of
about ``bucket_bytes``. Second pass: each bucket is put into an order that depends
on nothing but its records, shuffled by Fisher-Yates with a generator seeded by the
bucket, and written. A record's place in the whole order is its bucket's first place
plus its place there; shards are equal ranges of places, so that their row counts
differ by one at most (law ``rows``) and a shard is a run of bucket files.

A bucket that has outgrown ``OVERFULL`` times the wanted bytes, as one id may have many
rows or long ones, is dealt on over further buckets by a hash of id and text; rows that
agree in both go to one after the other. Beyond ``MANY_TWINS`` such rows their number in
the scan decides, and places depend on how the table is read.

Defined cases: a null text counts as empty and has size 1; null ids form one key;
rows that agree in all sort columns keep any order among themselves; an empty table
gives an empty table; further columns are carried along, none of them is renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recordloom.llm.common import crc32_unsigned, own_names, plain_names, saved, text_or_empty, unused

BUCKET_BYTES = 32 * 2**20
OVERFULL = 3  # times the wanted bytes from which a bucket is dealt on
MOST_PARTITIONS = 20_000
MANY_TWINS = 1_000_000  # rows alike in id and text that one task numbers
BUCKET, PART, PLACE = "__bucket", "__part", "__place"


def record_size() -> Column:
    """UTF-8 bytes of the text, plus one."""
    return F.octet_length(text_or_empty()).cast("long") + 1


def scatter(docs: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """Adds the bucket, and the part of it where one id overfills it."""
    size = docs.agg(F.sum(record_size())).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    dealt = docs.withColumn(BUCKET, F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets)))
    held = dealt.groupBy(BUCKET).agg(F.sum(record_size()).alias("__bytes"))
    large = saved(held.filter(F.col("__bytes") > OVERFULL * bucket_bytes), "large-buckets")
    if large.isEmpty():
        return dealt.withColumn(PART, F.lit(0).cast("long")).repartition(_partitions(buckets), BUCKET, PART)
    numbered = dealt.withColumns({"__row": F.monotonically_increasing_id(), "__same": F.xxhash64(F.lit(seed + 1), F.col("doc_id"), text_or_empty())})
    placed = numbered.join(large, BUCKET, "left")
    deep = placed.filter(F.col("__bytes").isNotNull())
    many = saved(deep.groupBy("__same").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > MANY_TWINS).select("__same", F.lit(True).alias("__many")), "many-twins")
    deep = deep.join(many, "__same", "left")
    twin = F.row_number().over(Window.partitionBy("__same").orderBy("__row")) - 1
    few = deep.filter(F.col("__many").isNull()).withColumn("__twin", twin.cast("long"))
    deep = few.unionByName(deep.filter(F.col("__many")).withColumn("__twin", F.col("__row")))
    part = F.pmod(F.pmod(F.col("__same"), F.ceil(F.col("__bytes") / F.lit(bucket_bytes))) + F.col("__twin"), F.ceil(F.col("__bytes") / F.lit(bucket_bytes)))
    columns = [*docs.columns, BUCKET]
    plain = placed.filter(F.col("__bytes").isNull()).select(*columns, F.lit(0).cast("long").alias(PART))
    return plain.unionAll(deep.select(*columns, part.cast("long").alias(PART))).repartition(_partitions(buckets), BUCKET, PART)


def _partitions(buckets: int) -> int:
    """So many that buckets seldom meet in a task by chance."""
    return min(MOST_PARTITIONS, 2 * buckets)


def shuffled_buckets(docs: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Both passes; the written records with bucket, part and place in it."""
    dealt = scatter(docs, seed, bucket_bytes)
    order = [c for c in ("doc_id", "text") if c in docs.columns]

    def shuffle(key, table):
        table = table.sort_by([(c, "ascending") for c in order])
        drawn = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()])
        table = table.take(pa.array(drawn.permutation(len(table))))  # Fisher-Yates
        return table.append_column(PLACE, pa.array(np.arange(len(table))))

    schema = StructType([*dealt.schema.fields, StructField(PLACE, LongType())])
    return saved(dealt.groupBy(BUCKET, PART).applyInArrow(shuffle, schema), "shuffled")


def sharded(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with ``__shard`` and ``__slot``, counted from 0 in each shard; with more underscores
    where a column of theirs has such a name."""
    plain, names = plain_names(docs, "doc_id", "text")
    written = shuffled_buckets(plain, seed, bucket_bytes)
    counts = written.groupBy(BUCKET, PART).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(BUCKET, PART).rowsBetween(Window.unboundedPreceding, -1))
    starts = saved(counts.withColumn("__start", F.coalesce(before, F.lit(0))), "bucket-starts")  # one short row per bucket
    total = starts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    small, more = divmod(total, shards)
    place, edge = F.col("__start") + F.col(PLACE), more * (small + 1)
    late = F.lit(more) + F.floor((place - edge) / F.lit(max(1, small)))
    shard = F.when(place < edge, F.floor(place / F.lit(small + 1))).otherwise(late).cast("int")
    start = F.col("__shard").cast("long") * small + F.least(F.col("__shard").cast("long"), F.lit(more))
    out = written.join(starts.drop("__n"), [BUCKET, PART]).withColumn("__shard", shard).withColumn("__slot", (place - start).cast("long"))
    shard_name, slot_name = unused("__shard", docs.columns), unused("__slot", docs.columns)
    return own_names(out, names, F.col("__shard").alias(shard_name), F.col("__slot").alias(slot_name))


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharded(docs.select("doc_id", "text"), shards, seed, bucket_bytes).select(
        "doc_id", record_size().alias("size"), crc32_unsigned(text_or_empty()).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
