"""Best-fit packing of document pieces into sequences by a distributed genetic algorithm.

Pieces are dealt by row number into blocks of bounded size. On each block several
islands, each a task of its own, evolve populations of packings; between the epochs
the best packing of an island moves to the next one of the block. A block's best
packing is taken, but the pieces of its badly filled sequences are released and
packed again together with those of the other blocks, level by level, until one
block is left. Pieces of full length are sequences of their own.

Only lengths travel; no task holds more than a block.

Defined cases: a null text is a document of the end id alone; repeated rows are
documents of their own; null ids are carried; an empty table gives no sequence; a
document longer than the capacity is cut, and only such a one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.llm import grouping_genetic as gga
from recordloom.llm.common import saved, text_or_empty, worker_holds
from recordloom.llm.word_ids import word_ids

CAPACITY = 2048
BLOCK_ITEMS = 4096
ISLANDS = 2
EPOCHS = 4
LEAST_PROGRESS = 0.1  # share of its pieces that a level must place for good, else it is the last
WELL_FILLED = 0.99
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises whole texts and cuts documents over ``capacity``: one row per piece."""

    def cut(batches):
        encoder = word_ids(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    piece = ids[i : i + 4 * capacity]
                    rows.append((doc_id, i // (4 * capacity), i // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def _islands(items: DataFrame, capacity: int, blocks: int, seed: int) -> DataFrame:
    """One row per block: the rows of its items in order, and the bin of each in the best packing found."""

    def gather(key, table):
        table = table.sort_by("row")
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int64()),
            "lengths": pa.array([table["length"].to_numpy().astype("<i4").tobytes()], pa.binary()),
        })

    def epoch(number: int):
        def run(batches):
            worker_holds("islands", dict)  # the words of the encoder, done by now, give their memory back
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                    held = [np.frombuffer(row[c], "<i4").reshape(-1, len(lengths)) for c in ("population", "elite") if row[c]]
                    found = gga.evolve(lengths, capacity, [p for x in held for p in x], [seed, row["block"], row["island"], number])
                    bins, score = gga.cost(found[0], lengths, capacity)
                    best = bins <= gga.least_bins(lengths, capacity)
                    packed = np.concatenate(found).astype("<i4").tobytes()
                    out.append({"block": row["block"], "island": row["island"], "lengths": row["lengths"], "population": packed, "best": found[0].astype("<i4").tobytes(), "bins": bins, "score": score, "done": best})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("population", pa.binary()), ("best", pa.binary()), ("bins", pa.int64()), ("score", pa.float64()), ("done", pa.bool_())]))

        return run

    schema = "block long, island int, lengths binary, population binary, best binary, bins long, score double, done boolean"
    blocked = items.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)))
    gathered = blocked.select("block", "row", "length").groupBy("block").applyInArrow(gather, "block long, lengths binary")
    state = gathered.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = state.withColumns({"population": F.lit(None).cast("binary"), "elite": F.lit(None).cast("binary")})
    for number in range(EPOCHS):
        dealt = state.repartition(min(4096, ISLANDS * blocks), "block", "island")
        state = saved(dealt.mapInArrow(epoch(number), schema), "islands")
        if state.filter("not done").isEmpty():
            break
        if number + 1 < EPOCHS:
            elites = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("best").alias("elite"))
            state = state.drop("best", "bins", "score", "done").join(elites, ["block", "island"])
    return state.groupBy("block").agg(F.min_by("best", F.struct("bins", "score", "island")).alias("best"))


def _placer(level: int, last: bool, capacity: int):
    """Gives the rows of a block their sequence and offset, and marks those of badly filled sequences as released."""

    def place(key, mine, best):
        mine = mine.sort_by("row")
        lengths = mine["length"].to_numpy()
        bins = np.frombuffer(best["best"][0].as_py(), "<i4")
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(lengths[order])
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = ends - lengths[order] - base
        fills = np.bincount(bins, weights=lengths)
        released = np.zeros(len(bins), dtype=bool) if last else (fills < WELL_FILLED * capacity)[bins]
        block = key[0].as_py()
        sequence = (np.int64(level) << 56) | (np.int64(block) << 16) | bins
        mine = mine.drop_columns(["block"])
        return mine.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("released", pa.array(released))

    return place


def pack(items: DataFrame, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """Adds sequence_id and offset to ``items``, which need a unique long ``row`` and a ``length`` up to ``capacity``."""
    open_ = items.filter(F.col("length") < capacity)
    done = [items.filter(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long")})]
    level, left = 0, open_.count()
    while left:
        blocks = -(-left // BLOCK_ITEMS)
        last = blocks == 1
        salt = seed + level

        best = saved(_islands(open_, capacity, blocks, salt), "packings")
        blocked = open_.withColumn("block", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema) + ", sequence_id long, offset long, released boolean"
        placed = saved(blocked.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_placer(level, last, capacity), fields), "placed")
        before, left = left, placed.filter("released").count()
        if left > (1 - LEAST_PROGRESS) * before:  # lengths that hardly fit together: packing them again would not help
            left = 0
            placed = placed.withColumn("released", F.lit(False))
        done.append(placed.filter("not released").drop("released"))
        open_ = placed.filter("released").drop("sequence_id", "offset", "released")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces with the sequence and the offset of each."""
    items = saved(pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(items, capacity).drop("row")
