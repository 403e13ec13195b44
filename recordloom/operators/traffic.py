"""Request-rate analytics on event tables.

Counting works on a timeline per key: each request adds one at its own time
and takes it back when its window has run out, so a trailing count is a running
sum, linear in the rows however many fall into a window. Keys are measured
first. If one is too large for a task, timelines are reduced to one row per instant,
however many requests fall on it, sorted over the cluster and cut into stretches of
an equal number of rows; sums of whole stretches are carried in as a start value. So
a key is spread over its stretches, and a burst over as many of them as it needs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from recordloom.functions.text import col, quoted
from recordloom.session import fresh_folder

MICROS = 1_000_000

# Rows of one key that one task may sort; the timelines of larger keys are cut.
HOT_ROWS = 1_000_000


def limited_requests(df: DataFrame, method: str = "method", path: str = "path") -> DataFrame:
    """Requests that count: GET and HEAD, except on paths ending in ``/status``."""
    return df.where(F.col(method).isin("GET", "HEAD") & ~F.col(path).endswith("/status"))


def client_key(forwarded_for: Column, address: Column) -> Column:
    return F.coalesce(forwarded_for, address)


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970. Zone-less timestamps are read as UTC."""
    kind = df.schema[ts].dataType
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(kind, T.TimestampNTZType) and zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        since = col(ts) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        day, hour, minute = (F.extract(F.lit(u), since) for u in ("DAY", "HOUR", "MINUTE"))
        whole = ((day * 24 + hour) * 60 + minute).cast("long") * (60 * MICROS)
        return whole + (F.extract(F.lit("SECOND"), since) * MICROS).cast("long")
    return F.unix_micros(col(ts).cast("timestamp"))


def has_hot_key(df: DataFrame, key: Column, hot_rows: int) -> bool:
    """Whether some key has more than ``hot_rows`` rows. One pass over the key column."""
    return not df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).isEmpty()


# Rows of a timeline that a task sorts, and partitions at most; the files are cut by row after that.
SORT_ROWS, SORT_PARTITIONS = 500_000, 20_000


def cut_timeline(steps: DataFrame, hot_rows: int) -> DataFrame:
    """Steps of keys (k, t, adds, ends) as one row per key and instant, in order of both, with ``part`` and ``cut``:
    stretches that follow each other and hold ``hot_rows`` rows at most.

    Equal instants are added up before the shuffle. Sampled ranges only spread the sorting; where
    a stretch ends is counted in the sorted files, so neither bursts nor bad samples make a long one.
    """
    spark = steps.sparkSession
    whole, ordered = fresh_folder(spark, "instants"), fresh_folder(spark, "timeline")
    steps.groupBy("k", "t").agg(F.sum("adds").alias("adds"), F.sum("ends").alias("ends")).write.parquet(whole)
    instants = spark.read.parquet(whole)
    parts = min(SORT_PARTITIONS, instants.count() // SORT_ROWS + 1)
    placed = instants.repartitionByRange(parts, "k", "t").sortWithinPartitions("k", "t").withColumn("part", F.spark_partition_id())
    placed.write.option("maxRecordsPerFile", 0).parquet(ordered)
    return spark.read.parquet(ordered).select("*", F.expr(f"_metadata.row_index div {max(hot_rows, 1)}L").alias("cut"))


def _counts_by_cuts(steps: DataFrame, hot_rows: int, retry_after: bool) -> DataFrame:
    """``k, t, inside`` and ``next_end`` for each instant of a request, see ``trailing_counts``."""
    spark = steps.sparkSession
    rows = cut_timeline(steps, hot_rows)
    group = ["k", "part", "cut"]
    within = Window.partitionBy(*group).orderBy("t")
    earlier = F.coalesce(F.sum("adds").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ended = F.sum("ends").over(within.rowsBetween(Window.unboundedPreceding, 0))
    end = F.when(F.col("ends") > 0, F.col("t"))
    local = [(earlier - ended).alias("local")]
    if retry_after:
        ahead = Window.partitionBy(*group).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, -1)
        local.append(F.min(end).over(ahead).alias("local_end"))
    # One row per stretch: a key's rows divided by ``hot_rows``.
    sums = rows.groupBy(*group).agg(F.sum(F.col("adds") - F.col("ends")).alias("net"), F.min(end).alias("end"))
    before = Window.partitionBy("k").orderBy("part", "cut").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("k").orderBy(F.col("part").desc(), F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("k").alias("ck"), F.col("part").alias("cp"), F.col("cut").alias("cc"),
        F.coalesce(F.sum("net").over(before), F.lit(0)).alias("before"), F.min("end").over(later).alias("later_end"),
    )
    same = F.col("k").eqNullSafe(F.col("ck")) & (F.col("part") == F.col("cp")) & (F.col("cut") == F.col("cc"))
    joined = rows.select(*group, "t", "adds", *local).where("adds > 0").join(carried, same)
    out = [F.col("k").alias("ik"), F.col("t").alias("it"), (F.col("local") + F.col("before")).alias("inside")]
    if retry_after:
        out.append(F.coalesce("local_end", "later_end").alias("next_end"))
    folder = fresh_folder(spark, "trailing")
    joined.select(*out).write.parquet(folder)  # the join to the requests can then split instants with many of them
    return spark.read.parquet(folder)


def trailing_counts(
    df: DataFrame,
    key: str | None,
    ts: str,
    seconds: int,
    limit: int | None = None,
    retry_after: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` plus ``trailing_count``: earlier requests of the same key less than
    ``seconds`` old. ``limit`` adds ``over_limit``; ``retry_after`` adds
    ``retry_at``, the time the oldest of them runs out plus one millisecond, for
    requests over the limit. ``key=None`` counts over all rows. Rows without a
    time get nulls.
    """
    span = seconds * MICROS
    at, who = micros(df, ts), (col(key) if key else F.lit("all"))
    hot = has_hot_key(df, who, hot_rows)

    def timeline(row: Column) -> DataFrame:
        """Two rows per request: where it starts to count and where it ends."""
        base = df.select(who.alias("k"), at.alias("at"), row.alias("row"))
        start = F.struct(F.col("at").alias("t"), F.lit(1).alias("adds"), F.lit(0).alias("ends"), F.col("row").alias("r"))
        stop = F.struct((F.col("at") + span).alias("t"), F.lit(0).alias("adds"), F.lit(1).alias("ends"), F.lit(None).alias("r"))
        return base.select("k", F.inline(F.array(start, stop))).toDF("k", "t", "adds", "ends", "r")

    whole = F.struct(*[col(c) for c in df.columns])
    if hot:
        counts = _counts_by_cuts(timeline(F.lit(None)).where("t IS NOT NULL").drop("r"), hot_rows, retry_after)
        requests = df.select(who.alias("k"), at.alias("t"), whole.alias("r"))
        rows = requests.join(counts, F.col("k").eqNullSafe(F.col("ik")) & (F.col("t") == F.col("it")), "left")
    else:
        steps = timeline(whole)
        upto = Window.partitionBy("k").orderBy("t")
        earlier = F.sum("adds").over(upto.rangeBetween(Window.unboundedPreceding, -1))
        ended = F.sum("ends").over(upto.rangeBetween(Window.unboundedPreceding, 0))
        local = [(F.coalesce(earlier, F.lit(0)) - F.coalesce(ended, F.lit(0))).alias("inside")]
        if retry_after:
            # Looking back in falling order: a frame that looks ahead would start over for every row.
            ahead = Window.partitionBy("k").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
            local.append(F.min(F.when(F.col("ends") == 1, F.col("t"))).over(ahead).alias("next_end"))
        rows = steps.select("k", "t", "r", "adds", *local).where("adds = 1")

    n = F.when(F.col("t").isNotNull(), F.col("inside"))
    out = [F.col("r." + quoted(c)).alias(c) for c in df.columns] + [n.alias("trailing_count")]
    if limit is not None:
        out.append((n >= limit).alias("over_limit"))
    if retry_after:
        over = n >= (limit if limit is not None else 1)
        out.append(F.when(over & (n > 0), F.timestamp_micros(F.col("next_end") + 1000)).alias("retry_at"))
    return rows.select(*out)


def _key_text(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit("null"))


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return zip(edges[:-1], edges[1:])


class SlidingWindow:
    """Admitted instants of one key that still count."""

    def __init__(self, limit: int, span: int, admitted: list[int] | None = None):
        self.limit, self.span, self.admitted = limit, span, deque(admitted or [])

    def take(self, instants: np.ndarray) -> np.ndarray:
        """Per ascending instant: 0 nobody, 1 the first request, 2 all requests.

        An instant counts once however many requests it admits. Stretches that
        are refused are jumped over, so the steps are those of the admitted
        instants, not of all.
        """
        verdict, i, n = np.zeros(len(instants), dtype=np.int32), 0, len(instants)
        if not self.limit:
            return verdict
        while i < n:
            now = int(instants[i])
            while self.admitted and now - self.admitted[0] >= self.span:
                self.admitted.popleft()
            if len(self.admitted) >= self.limit:
                free = self.admitted[0] + self.span
                i += max(int(np.searchsorted(instants[i:], free, side="left")), 1)
                continue
            verdict[i] = 1 if len(self.admitted) == self.limit - 1 else 2
            self.admitted.append(now)
            i += 1
        return verdict


class AverageRate:
    """Permits of one key, refilled evenly, at most one second's worth kept."""

    def __init__(self, permits_per_second: float):
        self.interval, self.most = MICROS / permits_per_second, permits_per_second
        self.stored, self.free_at = 0.0, None

    def take(self, instants: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Requests admitted at each ascending instant."""
        admitted, i, n = np.zeros(len(instants), dtype=np.int64), 0, len(instants)
        while i < n:
            now = int(instants[i])
            if self.free_at is None:
                self.free_at = now
            if self.free_at > now:
                i += max(int(np.searchsorted(instants[i:], self.free_at, side="left")), 1)
                continue
            if now > self.free_at:
                self.stored = min(self.most, self.stored + (now - self.free_at) / self.interval)
                self.free_at = now
            while admitted[i] < counts[i] and self.free_at <= now:
                spent = min(1.0, self.stored)
                self.stored -= spent
                self.free_at += int((1.0 - spent) * self.interval)
                admitted[i] += 1
            i += 1
        return admitted


# Milliseconds whose distinct instants travel as one row.
PACK = 2048


def sliding_admission(df: DataFrame, key: str, ts: str, order: str, limit: int | None, seconds: int) -> DataFrame:
    """``df`` plus ``admitted``: fewer than ``limit`` admitted requests of the key
    in the last ``seconds``; refused requests do not count. Rows without a time
    get null.

    Requests of one key in one millisecond are one instant; ``order`` tells which
    comes first. Each decision rests on the ones before, so a key is walked in
    order by one task, but on little data: instants are deduplicated and packed
    per key and two seconds before they get there, at most PACK to a row, however
    many rows the key has. Only admitted instants come back, at most ``limit`` per
    ``seconds`` and key, and rows are matched against those.
    """
    if limit is None or limit < 0:
        return df.withColumn("admitted", F.lit(True))
    keyed = df.withColumn("__k", _key_text(key)).withColumn("__at", F.unix_millis(F.timestamp_micros(micros(df, ts))))
    timed = keyed.where(F.col("__at").isNotNull())
    pack = F.floor(F.col("__at") / F.lit(PACK))
    packed = timed.groupBy("__k", pack.alias("__pack")).agg(
        F.sort_array(F.collect_set((F.col("__at") - pack * PACK).cast("int"))).alias("__in")
    )
    span = seconds * 1000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            keys, packs, inside = batch["__k"].to_numpy(), batch["__pack"].to_numpy(), batch["__in"].to_numpy()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in _runs(keys):
                if state is None or keys[a] != current:
                    current, state = keys[a], SlidingWindow(limit, span)
                at = np.repeat(packs[a:b] * PACK, [len(x) for x in inside[a:b]]) + np.concatenate(inside[a:b])
                verdict = state.take(at)
                taken = np.flatnonzero(verdict)
                found.append((np.repeat(keys[a : a + 1], len(taken)), at[taken], verdict[taken]))
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pd.DataFrame(dict(zip(("__k", "__at", "__verdict"), columns)))

    ordered = packed.repartition("__k").sortWithinPartitions("__k", "__pack")
    taken = ordered.mapInPandas(walk, "__k string, __at long, __verdict int")
    judged = keyed.join(taken, ["__k", "__at"], "left")
    # An instant with one place left admits its first request only. The rows of
    # an instant are together after a shuffled join, so this sorts nothing anew.
    first = F.min(col(order)).over(Window.partitionBy("__k", "__at"))
    admitted = F.coalesce((F.col("__verdict") == 2) | ((F.col("__verdict") == 1) & (col(order) == F.col("__first"))), F.lit(False))
    admitted = F.when(F.col("__at").isNotNull(), admitted)
    return judged.withColumn("__first", first).select(*[col(c) for c in df.columns], admitted.alias("admitted"))


def average_admission(df: DataFrame, key: str, ts: str, order: str, limit: int | None, seconds: int) -> DataFrame:
    """``df`` plus ``admitted`` under an even rate of ``limit / seconds`` per key."""
    if limit is None or limit <= 0:
        return df.withColumn("admitted", F.lit(True))
    keyed = df.withColumn("__k", _key_text(key)).withColumn("__at", micros(df, ts))
    timed = keyed.where(F.col("__at").isNotNull())
    instants = timed.groupBy("__k", "__at").agg(F.count("*").alias("__n"))
    rate = limit / seconds

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            keys, at, n = batch["__k"].to_numpy(), batch["__at"].to_numpy(), batch["__n"].to_numpy()
            taken = np.zeros(len(batch), dtype=np.int64)
            for a, b in _runs(keys):
                if state is None or keys[a] != current:
                    current, state = keys[a], AverageRate(rate)
                taken[a:b] = state.take(at[a:b], n[a:b])
            yield batch.assign(__taken=taken)[taken > 0]

    walked = _walk_in_order(instants, walk, "__taken long")
    turn = F.row_number().over(Window.partitionBy("__k", "__at").orderBy(col(order)))
    joined = keyed.join(walked, ["__k", "__at"], "left").withColumn("__turn", turn)
    admitted = F.when(F.col("__at").isNotNull(), F.col("__turn") <= F.coalesce("__taken", F.lit(0)))
    return joined.select(*[col(c) for c in df.columns], admitted.alias("admitted"))


def _walk_in_order(instants: DataFrame, walk, extra: str) -> DataFrame:
    """Run ``walk`` over all instants of a key in time order, batch by batch."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in instants.schema] + [extra])
    ordered = instants.repartition("__k").sortWithinPartitions("__k", "__at")
    return ordered.mapInPandas(walk, schema)
