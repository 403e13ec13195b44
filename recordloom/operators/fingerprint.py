"""Fingerprints of tables: equal for the same rows equally often, in any order of rows and columns.

A row is hashed with its labels in order, twice with different seeds; a table's
fingerprint is its number of rows and both sums of hashes modulo 2**64. So it is
additive: that of a dataset is made from those of its loads, without reading a record.
Different tables have the same one by chance only; it is no protection against tables that are
made to collide.

Hashes are summed in three parts of 22 bits, so that no sum overflows below 2**41 rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.text import col
from recordloom.sources.records import labels_of

SEEDS = (17, 40961)
PART_BITS, PARTS = 22, 3
_WRAP = 1 << 64


def row_hash(cells: dict[str, Column], seed: int) -> Column:
    """Hash of a record given as label to text; an absent cell differs from an empty one."""
    fields = [x for label in sorted(cells) for x in (F.lit(label), cells[label].isNull(), cells[label])]
    return F.xxhash64(F.lit(seed), *fields)


def sums(cells: dict[str, Column], counted: Column | None = None) -> list[Column]:
    """Aggregates that ``from_sums`` turns into a fingerprint; of the rows for which ``counted`` holds."""
    found = []
    for s, seed in enumerate(SEEDS):
        h = row_hash(cells, seed)
        for k in range(PARTS):
            part = F.shiftrightunsigned(h, k * PART_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1).cast("long"))
            found.append(F.sum(part if counted is None else F.when(counted, part)).alias(f"hash_{s}_{k}"))
    return found


def from_sums(rows: int, values: dict) -> str:
    whole = [sum((values[f"hash_{s}_{k}"] or 0) << (k * PART_BITS) for k in range(PARTS)) % _WRAP for s in range(len(SEEDS))]
    return f"{rows}:" + "".join(f"{x:016x}" for x in whole)


def added(parts: Iterable[str]) -> str:
    """The fingerprint of several tables put together."""
    rows, whole = 0, [0] * len(SEEDS)
    for part in parts:
        n, hashes = part.split(":")
        rows += int(n)
        whole = [(x + int(hashes[16 * s : 16 * s + 16], 16)) % _WRAP for s, x in enumerate(whole)]
    return f"{rows}:" + "".join(f"{x:016x}" for x in whole)


def of_table(df: DataFrame) -> str:
    """The fingerprint of a table of records, whatever its row numbers: one aggregate."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), *sums({label: col(label) for label in labels_of(df)})).first().asDict()
    return from_sums(found["rows"], found)
