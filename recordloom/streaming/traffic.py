"""Request rates on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordloom.functions.text import col
from recordloom.operators.traffic import SlidingWindow, micros


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int, step: int, delay: str) -> DataFrame:
    """Requests per key in windows of ``seconds`` starting every ``step`` seconds.
    A window is final once the watermark, ``delay`` behind the newest event,
    has passed its end."""
    when = F.timestamp_micros(micros(events, ts))
    timed = events.select(col(key).alias("key"), when.alias("ts")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", f"{seconds} seconds", f"{step} seconds"), "key").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "key", "n")


def sliding_admission_stream(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int, delay: str) -> DataFrame:
    """``key, order, at, admitted`` per event: the batch rule of
    ``operators.traffic.sliding_admission`` with each key's admitted instants
    kept as state. Events are taken in time order within a micro-batch; idle
    keys are forgotten when the watermark passes their window."""
    span = seconds * 1000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))  # a key's slim rows of one micro-batch, bounded by its trigger
        rows = rows.sort_values(["at_ms", "order"], kind="stable")
        window = SlidingWindow(limit, span, list(state.get[0]) if state.exists else None)
        at = rows["at_ms"].to_numpy()
        instants, first, which = np.unique(at, return_index=True, return_inverse=True)
        verdict = window.take(instants)[which]
        admitted = (verdict == 2) | ((verdict == 1) & (np.arange(len(at)) == first[which]))
        state.update((list(window.admitted),))
        if window.admitted:
            state.setTimeoutTimestamp(max(int(window.admitted[-1]) + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "order": rows["order"].to_numpy(), "at_ms": at, "admitted": admitted})

    when = F.timestamp_micros(micros(events, ts)).alias("ts")
    timed = events.select(col(key).alias("key"), col(order).alias("order"), when).withWatermark("ts", delay)
    slim = timed.withColumn("at_ms", F.unix_millis("ts"))
    key_type = slim.schema["key"].dataType.simpleString()
    order_type = slim.schema["order"].dataType.simpleString()
    return slim.groupBy("key").applyInPandasWithState(
        step,
        f"key {key_type}, order {order_type}, at_ms long, admitted boolean",
        "admitted array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
