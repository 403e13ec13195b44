"""CSV text to records.

Files are read line by line with Spark's splittable text source. Where quoted
cells hold line breaks, lines are put together again without giving a file to
one task and without shuffling the text: each scan block is summed up as a step
from "outside quotes" or "inside quotes" to the state at its end, the few
summaries are chained per file, and then every block can be read on its own.
Only records that cross a block edge, at most two parts per block, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from recordloom.errors import LoadRejected
from recordloom.operators import fingerprint
from recordloom.session import fresh_folder
from recordloom.sources.csv_text import cells, decoded, ends_open, undecodable
from recordloom.sources.records import ROWNR
from recordloom.sources.sniff import LONGEST_LOOKUP, FileGroup, charset_votes, file_groups, literal_path

# Rows of a helper table of a few numbers up to which it is broadcast (some 20 MB).
BROADCAST_ROWS = 200_000

# Characters of file paths that one scan takes along; more files are read as several scans.
PATH_CHARS = 16_000_000

_SEQUENCE = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in its partition
_WHOLE = ("UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lines(spark: SparkSession, group: FileGroup, base: int = 0) -> DataFrame:
    """``base, block, id, value, room``: lines in order of the first three.

    ``base`` is the row number base of the file and stands for it, ``block`` is
    the offset of the scan split, ``id`` grows within it, ``room`` is its length in
    bytes. Very many files are read as several scans, so that the paths which each
    of them looks up stay small; the text is never shuffled for them. UTF-16 and UTF-32 files
    cannot be split at line ends by the text source; such a file is decoded as
    one value, and Spark refuses those over 2 GB.
    """
    if len(group.files) > 1 and sum(len(p) for p, _ in group.files) > PATH_CHARS:
        parts, held = [[]], 0
        for file in group.files:
            if held + len(file[0]) > PATH_CHARS and parts[-1]:
                parts, held = [*parts, []], 0
            parts[-1].append(file)
            held += len(file[0])
        return reduce(DataFrame.unionAll, [lines(spark, replace(group, files=tuple(p), root=None), base) for p in parts])
    paths = group.root or [literal_path(p) for p, _ in group.files]
    where = F.col("_metadata.file_path").alias("file")
    if group.charset in _WHOLE:
        name = "UTF-16" if group.charset.startswith("UTF-16") else "UTF-32"
        text = F.regexp_replace(F.decode("content", name), "^\ufeff", "")
        text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", "")
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        split = whole.select(where, F.posexplode(F.split(text, "\n", -1)).alias("id", "value"))
        found = split.select("file", F.lit(0).cast("long").alias("block"), F.col("id").cast("long").alias("id"), "value", F.lit(None).cast("long").alias("room"))
    else:
        raw = spark.read.option("recursiveFileLookup", "true").text(paths)
        block, text = F.col("_metadata.file_block_start"), decoded(F.col("value"), group.charset)
        room = F.col("_metadata.file_block_length").alias("room")
        found = raw.select(where, block.alias("block"), F.monotonically_increasing_id().alias("id"), text.alias("value"), room)
    if len(group.files) == 1:
        return found.select(F.lit(base + group.files[0][1]).cast("long").alias("base"), "block", "id", "value", "room")
    table = spark.createDataFrame([(p, base + b) for p, b in group.files], "path string, base long")
    return found.join(F.broadcast(table), F.col("file") == F.col("path")).select("base", "block", "id", "value", "room")  # PATH_CHARS at most


def _crowded() -> Column:
    """Whether a line's position, which counts from the start of its scan partition, does not fit its block."""
    return F.col("id").bitwiseAND(F.lit(_SEQUENCE)) >= F.col("room")


def _counted_by_block(text: DataFrame, folder: str) -> DataFrame:
    """``text`` with ``id`` counted from the first line of each block: one more pass, one row per block."""
    text.groupBy("base", "block").agg(F.min("id").alias("first")).write.parquet(folder)
    firsts = text.sparkSession.read.parquet(folder)
    placed = text.join(_sized(firsts, firsts.count()), ["base", "block"])
    return placed.select("base", "block", (F.col("id") - F.col("first")).alias("id"), "value", "room")


def _with_state(df: DataFrame, step: Window, done_out: str, done_in: str) -> DataFrame:
    """``df`` plus ``state`` (0 outside, 1 inside quotes) before each row of an
    ordered window whose first row starts outside.

    A row keeps both states, swaps them, or sends both to one state. The last row
    of the third kind, which only backslashes can make, and the parity of the
    swaps since then decide.
    """
    upto = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = step.rowsBetween(Window.unboundedPreceding, -1)
    out, into = F.col(done_out), F.col(done_in)
    swap = F.when(out & ~into, 1).otherwise(0)
    df = df.withColumn("__parity", F.sum(swap).over(upto) % 2)
    df = df.withColumn("__fixed", F.when(out == into, (out.cast("int") + F.col("__parity")) % 2))
    last = F.coalesce(F.last("__fixed", ignorenulls=True).over(before), F.lit(0))
    past = F.coalesce(F.last("__parity").over(before), F.lit(0))
    return df.withColumn("state", (last + past) % 2).drop("__parity", "__fixed")


def block_summaries(text: DataFrame) -> DataFrame:
    """One row per scan block: ``base, block`` and

    - ``inside``: whether it starts inside quotes; its lines up to id ``close``
      (all if null) then belong to the record that starts at ``home.block, home.id``,
    - ``ends_inside``: whether it ends inside; lines from id ``opened`` on (null if
      the record came in from before) then belong to a record that goes on.

    All lines of a block are in one scan task, so the aggregate is complete
    before the shuffle and sends one row per block.
    """
    out, into = ends_open(F.col("value")), ends_open(F.col("value"), inside=True)
    event = F.when(out | ~into, F.struct("id", out.alias("o"), into.alias("i")))
    events = text.groupBy("base", "block").agg(F.sort_array(F.collect_list(event)).alias("events"), F.count_if(_crowded()).alias("crowded"))

    def walk(start: bool) -> Column:
        none = F.lit(None).cast("long")
        zero = F.struct(F.lit(start).alias("s"), none.alias("opened"), none.alias("closed"))

        def step(acc: Column, e: Column) -> Column:
            now = F.when(acc["s"], e["i"]).otherwise(e["o"])
            opened = F.when(now & ~acc["s"], e["id"]).when(now, acc["opened"])
            closed = F.coalesce(acc["closed"], F.when(acc["s"] & ~now, e["id"]))
            return F.struct(now.alias("s"), opened.alias("opened"), closed.alias("closed"))

        return F.aggregate("events", zero, step)

    both = events.select("base", "block", "crowded", walk(False).alias("f"), walk(True).alias("t"))
    flat = both.select("*", F.col("f.s").alias("out"), F.col("t.s").alias("into"))
    # One row per scan block of a file: its size / 128 MB rows in a window.
    step = Window.partitionBy("base").orderBy("block")
    inside = F.col("state") == 1
    chained = _with_state(flat, step, "out", "into").select(
        "base", "block", "crowded", inside.alias("inside"), F.when(inside, F.col("t")).otherwise(F.col("f")).alias("m")
    )
    opener = F.when(F.col("m.s") & F.col("m.opened").isNotNull(), F.struct("block", F.col("m.opened").alias("id")))
    chained = chained.withColumn("opener", opener)
    home = F.last("opener", ignorenulls=True).over(step.rowsBetween(Window.unboundedPreceding, -1))
    return chained.select(
        "base",
        "block",
        "inside",
        F.when(F.col("inside"), F.col("m.closed")).alias("close"),
        home.alias("home"),
        F.col("m.s").alias("ends_inside"),
        F.when(F.col("m.s"), F.col("m.opened")).alias("opened"),
        "crowded",
    )


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole records, block by block in order, to one row per record.

    Every block starts and ends outside quotes here. Only lines that change
    sides are stepped through.
    """
    state, last, pending = False, None, None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        base, block, number, value = zip(*found)
        arrays = [pa.array(c, pa.int64()) for c in (base, block, number)] + [pa.array(value, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["base", "block", "id", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        base, block, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("base", "block", "id"))
        out, into = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("out", "into"))
        values = batch.column("value").to_pylist()
        edge = np.ones(len(base), dtype=bool)
        edge[1:] = (base[1:] != base[:-1]) | (block[1:] != block[:-1])
        edge[0] = last != (base[0], block[0])
        last = (base[-1], block[-1])
        before, done = np.empty(len(base), dtype=bool), 0
        for e in np.flatnonzero(out | ~into | edge).tolist():
            before[done:e] = state
            state = before[e] = state and not edge[e]
            state = bool(into[e]) if state else bool(out[e])
            done = e + 1
        before[done:] = state
        starts = np.flatnonzero(~before).tolist()
        if not starts:
            pending[3].extend(values)
            continue
        found = []
        if pending:
            pending[3].extend(values[: starts[0]])
            found.append((*pending[:3], "\n".join(pending[3])))
        for a, b in zip(starts, starts[1:]):
            found.append((base[a], block[a], number[a], values[a] if b == a + 1 else "\n".join(values[a:b])))
        a = starts[-1]
        pending = (base[a], block[a], number[a], values[a:])
        if found:
            yield rows(found)
    if pending:
        yield rows([(*pending[:3], "\n".join(pending[3]))])


def joined_lines(text: DataFrame, summaries: DataFrame, n_blocks: int) -> DataFrame:
    """Lines to records that may span lines and blocks: same columns as ``lines``.

    A line without a summary means that the scan was split differently than it
    was summed up; such lines get ``id`` -1 for the caller to notice.
    """
    known = summaries.select(
        F.col("base").alias("sb"), F.col("block").alias("sk"), "inside", "close", "home", "ends_inside", "opened"
    )
    placed = text.join(_sized(known, n_blocks), (F.col("base") == F.col("sb")) & (F.col("block") == F.col("sk")), "left")
    orphan = F.col("inside") & (F.col("close").isNull() | (F.col("id") <= F.col("close")))
    tail = F.col("ends_inside") & (F.col("id") >= F.col("opened"))
    placed = placed.withColumn("orphan", F.coalesce(orphan, F.lit(False))).withColumn("tail", F.coalesce(tail, F.lit(False)))
    placed = placed.withColumn("id", F.when(F.col("inside").isNotNull(), F.col("id")).otherwise(-1))

    crossing = F.col("orphan") | F.col("tail")
    start = F.when(F.col("orphan"), F.col("home")).otherwise(F.struct("block", F.col("opened").alias("id")))
    parts = placed.where(crossing).select("base", start.alias("start"), F.struct("block", "id", "value").alias("part"))
    joined = parts.groupBy("base", "start").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    long = joined.select(
        "base",
        F.col("start.block").alias("block"),
        F.col("start.id").alias("id"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"),
    )
    out, into = ends_open(F.col("value")), ends_open(F.col("value"), inside=True)
    within = placed.where(~crossing).select("base", "block", "id", "value", out.alias("out"), into.alias("into"))
    if n_blocks > BROADCAST_ROWS:  # a shuffled join loses the order of the scan and may split a block
        within = within.repartition("base", "block").sortWithinPartitions("base", "block", "id")
    return within.mapInArrow(_assemble, "base long, block long, id long, value string").unionAll(long)


@dataclass
class Parsed:
    """Records of one file group and what was seen while they were made."""

    rows: DataFrame
    group: FileGroup
    seen: Observation
    temporary: list[str]  # helper folders, of no use once ``rows`` are written

    def facts(self) -> dict:
        """Counts, once an action on ``rows`` has ended."""
        return self.seen.get


def parse(
    spark: SparkSession,
    group: FileGroup,
    labels: list[str],
    quoted_newlines: bool,
    exact_headers: bool = False,
    base: int = 0,
    lone_backslash: str = "keep",
    keep_rejects: bool = False,
    watch: bool = True,
    exact_numbers: bool = False,
) -> Parsed:
    """Plan the records of a group; the columns are ``labels`` in that order.

    Header lines are known by their text in the first block of a file. If data
    repeat that text there, the observed count of headers is too high and the
    caller plans again with ``exact_headers``, which looks up the first line of
    each file. Row numbers come from the position in the scan partition, which is
    unique as long as it fits the block; where the count of ``crowded`` lines shows
    otherwise (a partition of many short-lined blocks), ``exact_numbers`` counts
    lines from the start of their block. ``watch=False`` leaves the counting out.
    """
    records, temporary = lines(spark, group, base), []
    if exact_numbers:
        temporary.append(fresh_folder(spark, "block-starts"))
        records = _counted_by_block(records, temporary[-1])
    if quoted_newlines:
        folder = fresh_folder(spark, "blocks")
        temporary.append(folder)
        block_summaries(records).write.parquet(folder)
        summaries = spark.read.parquet(folder)
        ends = summaries.groupBy("base").agg(F.max_by("ends_inside", "block").alias("open"), F.count("*").alias("n"))
        open_files, n_blocks = ends.agg(F.count_if("open"), F.sum("n")).first()
        if not exact_numbers and summaries.agg(F.sum("crowded")).first()[0]:
            return parse(spark, group, labels, True, exact_headers, base, lone_backslash, keep_rejects, watch, True)
        if open_files:
            raise LoadRejected("a quoted cell is not closed at the end of the file")
        records = joined_lines(records, summaries, n_blocks)
    records = records.withColumn("stray", F.col("id") < 0)

    head = (F.col("block") == 0) & (F.col("value") == F.lit(group.header))
    if exact_headers:
        firsts = records.where(head).groupBy("base").agg(F.min("id").alias("first_id")).withColumnRenamed("base", "first_base")
        on = (F.col("base") == F.col("first_base")) & (F.col("id") == F.col("first_id")) & (F.col("block") == 0)
        firsts = _sized(firsts, len(group.files))  # one row per file
        records = records.join(firsts, on, "left").withColumn("head", F.col("first_id").isNotNull())
    else:
        records = records.withColumn("head", F.coalesce(head, F.lit(False)))
    # A line takes at least one byte, so block offset plus position in the block
    # grows strictly over a file: numbers without a shuffle, with gaps.
    place = F.col("block") + F.col("id").bitwiseAND(F.lit(_SEQUENCE)) + F.when(F.col("block") > 0, 1).otherwise(0)
    records = records.withColumn(ROWNR, F.col("base") + place)

    values = records.withColumn("cells", cells(F.col("value"), group.sep, lone_backslash))
    if quoted_newlines:
        is_open = F.lit(False)
    else:
        is_open = ends_open(F.col("value"))
    data, n = ~F.col("head"), len(group.labels)
    seen = Observation()
    metrics = [
        F.count_if(data).alias("rows"),
        F.count_if(F.col("head")).alias("heads"),
        F.count_if(is_open).alias("open"),
        F.count_if(F.col("stray")).alias("stray"),
        F.lit(0).alias("crowded") if quoted_newlines or exact_numbers else F.count_if(_crowded()).alias("crowded"),
        F.count_if(undecodable(F.col("value"), group.charset)).alias("undecodable"),
        F.count_if(data & (F.size("cells") > n)).alias("overlong"),
        F.max(F.when(data, F.col(ROWNR))).alias("max_rownr"),
    ]
    metrics += fingerprint.sums({label: F.get("cells", F.lit(i)) for i, label in enumerate(group.labels)}, data)
    place = {label: i for i, label in enumerate(group.labels)}
    # Lengths matter beyond LONGEST_LOOKUP only, so short lines are not measured.
    measured = data & (F.octet_length("value") > LONGEST_LOOKUP)
    for i, label in enumerate(labels):
        length = F.length(F.get("cells", F.lit(place[label])))
        metrics.append(F.max(F.when(measured, length)).alias(f"len_{i}"))
    watched = (values.observe(seen, *metrics) if watch else values).where(data)
    picked = [F.get("cells", F.lit(place[label])).alias(label) for label in labels]
    extra = [F.size("cells").alias("__cells"), F.col("value").alias("__text")] if keep_rejects else []
    return Parsed(watched.select(ROWNR, *picked, *extra), group, seen, temporary)


@dataclass(frozen=True)
class Surprises:
    """What one pass over the text tells that the heads of files cannot."""

    joined: bool  # lines must be joined
    repeated: bool  # a data line in a first block equals its header
    crowded: bool  # row numbers need exact counting
    broken: bool  # some line is not text in the charset of its head


def surprises(spark: SparkSession, group: FileGroup) -> Surprises:
    head = (F.col("block") == 0) & (F.col("value") == F.lit(group.header))
    open_, heads, crowded, broken = lines(spark, group).agg(
        F.count_if(ends_open(F.col("value"))), F.count_if(head), F.count_if(_crowded()), F.count_if(undecodable(F.col("value"), group.charset))
    ).first()
    return Surprises(group.quoted_newlines or open_ > 0, heads != len(group.files), crowded > 0, broken > 0)


def _settled_groups(spark: SparkSession, path: str | list[str], charset: str | None, sep: str | None) -> list[tuple[FileGroup, Surprises]]:
    """File groups under the rule of loads: where lines are not text in a charset that only the head of
    their file shows, all lines of the file vote. Every round settles more files, so this ends."""
    known: dict[str, str] = {}
    while True:
        groups = file_groups(spark, path, charset, sep, known)
        seen = [(g, surprises(spark, g)) for g in groups]
        doubtful = {p: g.charset for g, s in seen if s.broken and not g.settled and g.charset not in _WHOLE for p, _ in g.files}
        votes = charset_votes(spark, list(doubtful)) if doubtful else {}
        if all(votes.get(p, c) == c for p, c in doubtful.items()):
            return seen
        known |= votes


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    lone_backslash: str = "keep",
    keep_rejects: bool = False,
    charset: str | None = None,
    sep: str | None = None,
) -> DataFrame:
    """Records of CSV files as a lazy table, with over-long rows cut to their
    labels. Loading (``plans.load``) rejects those; ``overlong_rows`` lists them."""
    groups = _settled_groups(spark, path, charset, sep)
    labels = list(groups[0][0].labels)
    parts = []
    for g, s in groups:
        options = {"lone_backslash": lone_backslash, "keep_rejects": keep_rejects, "watch": False, "exact_numbers": s.crowded}
        parts.append(parse(spark, g, labels, s.joined, s.repeated, **options).rows)
    return reduce(DataFrame.unionAll, parts)


def overlong_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows with more cells than the header has labels: number, cells, text."""
    rows = scan_csv(spark, path, keep_rejects=True)
    labels = len([c for c in rows.columns if not c.startswith("__")])
    return rows.where(F.col("__cells") > labels).select(
        ROWNR, F.col("__cells").alias("n_cells"), F.lit(labels).alias("n_labels"), F.col("__text").alias("line")
    )
