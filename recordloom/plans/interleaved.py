"""A layout in which equality on any of several columns skips most row groups.

Sorted by one column, a table helps lookups of that column only. Here every column gets
a quantile rank of a few bits; the bits of all ranks, interleaved, make one number, and
the table is range-partitioned and sorted by it. A file then holds a box in the space of
the ranks: narrow in each column, so its statistics leave it out for most values.

The ranks come from splitters taken from a sample of at most about ``SAMPLE_ROWS`` rows;
they decide where a row lies, not whether it is found. Rows are sorted by row number
within equal numbers, and the row number is part of the partitioning, so a combination
of values that holds many of the rows is spread over many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.text import col
from recordloom.operators.profile import lookup_columns
from recordloom.plans.load import write_records
from recordloom.sources.records import ROWNR, labels_of
from recordloom.sources.sniff import LONGEST_LOOKUP

SAMPLE_ROWS = 50_000
RANK_BITS = 8
FILE_ROWS = 1_000_000
KEY = "__interleaved"


def splitters(records: DataFrame, labels: list[str], rows: int, bits: int = RANK_BITS) -> dict[str, list[str]]:
    """Values that cut each column into up to 2**bits ranks of about equal size, from the sample."""
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    picked = records.select(*[F.substring(col(x), 1, LONGEST_LOOKUP).alias(f"c{i}") for i, x in enumerate(labels)])
    sample = (picked.sample(share, seed=1) if share < 1 else picked).collect()  # some SAMPLE_ROWS short rows
    found = {}
    for i, label in enumerate(labels):
        values = sorted((r[i] for r in sample if r[i] is not None), key=lambda v: v.encode("utf-8", "surrogatepass"))
        cuts = [values[len(values) * k // 2**bits] for k in range(1, 2**bits)] if values else []
        found[label] = list(dict.fromkeys(cuts))
    return found


def rank(c: Column, cuts: list[str]) -> Column:
    """How many cuts a value has reached: a tree of comparisons. Absent values have rank 0."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(c < F.lit(cuts[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.coalesce(F.when(c.isNotNull(), tree(0, len(cuts))), F.lit(0))


def interleaved(ranks: list[Column], sizes: list[int]) -> Column:
    """One number from several ranks: their bits in turn, the highest first."""
    widths = [max(1, n.bit_length()) for n in sizes]
    key = F.lit(0).cast("long")
    for step in range(max(widths, default=0)):
        for r, width in zip(ranks, widths):
            if step < width:
                bit = F.shiftright(r, width - 1 - step).bitwiseAND(F.lit(1)).cast("long")
                key = F.shiftleft(key, 1).bitwiseOR(bit)
    return key


def write_interleaved_layout(records: DataFrame, path: str, labels: list[str], file_rows: int = FILE_ROWS) -> list[str]:
    """Writes records so that equality on any of ``labels`` (up to seven) skips most files; bloom filters on
    every short column besides, whose names are returned."""
    unknown = [x for x in labels if x not in labels_of(records)]
    if unknown or not 1 <= len(labels) <= 63 // RANK_BITS:
        raise ValueError(f"not columns of the table, or too many: {labels}")
    rows = records.count()
    cuts = splitters(records, labels, rows)
    key = interleaved([rank(col(x), cuts[x]) for x in labels], [len(cuts[x]) for x in labels])
    keyed = records.withColumn(KEY, key)
    dealt = keyed.repartitionByRange(max(1, -(-rows // file_rows)), KEY, ROWNR).sortWithinPartitions(KEY, ROWNR)
    short = [r["column_name"] for r in lookup_columns(records, LONGEST_LOOKUP).collect()]
    write_records(dealt.drop(KEY), path, short)
    return short
