"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from recordloom.functions.text import quoted
from recordloom.session import fresh_folder


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks of one job, never the
    work of the jobs before it.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(folder)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def plain_names(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``docs`` with all columns but ``kept`` called c0, c1, ..., which no operator uses, and the pairs of
    names for ``own_names``. So further columns may have any name."""
    names = [(c if c in kept else f"c{i}", c) for i, c in enumerate(docs.columns)]
    return docs.select(*[F.col(quoted(c)).alias(n) for n, c in names]), names


def own_names(docs: DataFrame, names: list[tuple[str, str]], *more: str) -> DataFrame:
    """The columns of ``plain_names`` under their own names, and ``more`` columns behind them."""
    return docs.select(*[F.col(n).alias(c) for n, c in names], *more)


def unused(name: str, columns: list[str]) -> str:
    """``name``, behind as many underscores as it takes to be none of ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def crc32_unsigned(column):
    """CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(F.encode(column, "UTF-8"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Bytes that the word table of a Python worker may take; an entry counts with what a dict needs for it.
TABLE_BYTES = 128 << 20
ENTRY_BYTES = 120
LONGEST_WORD = 40  # longer ones are not kept


class BoundedTable(dict):
    """Values by word, made as words come, in at most ``TABLE_BYTES``.

    Two generations take half of that each: when the new one is full it becomes the old
    one, and words of the old one that come again move on.
    """

    def __init__(self):
        super().__init__()
        self.old, self.free = {}, TABLE_BYTES // 2

    def make(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST_WORD:
            self.free -= ENTRY_BYTES + sys.getsizeof(word) + sys.getsizeof(value)
            if self.free < 0:
                self.old, self.free = self.copy(), TABLE_BYTES // 2
                self.clear()
            self[word] = value
        return value


def worker_holds(name: str, make: Callable[[], object]):
    """What this Python process keeps from task to task: one thing only, the last that was
    asked for. A worker that goes on to another operator gives the memory back."""
    module = "__recordloom_worker__"
    state = sys.modules.setdefault(module, types.ModuleType(module)).__dict__
    if state.get("name") != name:
        state["name"] = state["thing"] = None
        gc.collect()
        _give_back()
        state["thing"] = make()
        state["name"] = name
    return state["thing"]


def _give_back() -> None:
    """Returns freed memory to the system where the C library and Arrow can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
