"""Records in order of a text column: a sorted side table and exact counts in it.

For one label the side table has the value and number of every row, range-partitioned
and sorted by value, then row number; as the number takes part, a value that half of
the rows share is spread over many partitions. Absent values come last. Cells of
``CELL_ROWS`` consecutive entries are counted with the entries before them, so a page
at any position, up or down, reads the entries of one or two cells, and then the
records with the page's row numbers.

Side tables of several loads are merged from their entries alone (``merged``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.functions.text import col
from recordloom.operators.paging import count_name, sort_columns, sort_key
from recordloom.plans.row_directory import CELL_ROWS, with_rows_before
from recordloom.session import fresh_folder
from recordloom.sources.records import ROWNR, labels_of

PARTITION_ROWS = 4_000_000
LISTED = 1000  # row numbers that a filter names one by one; more are joined
KEY = ["absent", "value", "rownr"]


class OrderDirectory:
    """The order of a table of records by one label, kept in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.entries = spark.read.parquet(f"{folder}/entries")
        self.cells = spark.read.parquet(f"{folder}/cells")
        self.shape = spark.read.parquet(f"{folder}/shape").first()  # one row: label, rows, present

    @staticmethod
    def write(records: DataFrame, label: str, folder: str, cell_rows: int = CELL_ROWS) -> OrderDirectory:
        c = col(label)
        entries = records.select(c.isNull().alias("absent"), c.alias("value"), F.col(ROWNR).alias("rownr"))
        return _write(entries, label, folder, cell_rows)

    @staticmethod
    def merged(parts: list[OrderDirectory], folder: str, cell_rows: int = CELL_ROWS) -> OrderDirectory:
        """One directory for the rows of several, from their entries."""
        label = parts[0].shape["label"]
        if any(p.shape["label"] != label for p in parts):
            raise ValueError("the directories are of different columns")
        entries = reduce(DataFrame.unionAll, [p.entries.select(*KEY) for p in parts])
        return _write(entries, label, folder, cell_rows)

    # -- positions -----------------------------------------------------------

    def entries_at(self, first: int, last: int) -> DataFrame:
        """The entries at the positions ``first`` to ``last``: absent, value, rownr. A bounded read: two cells at
        most beside those that lie in between whole."""
        if last < first:
            return self.entries.select(*KEY).where(F.lit(False))
        touched = self.cells.where((F.col("before") <= last) & (F.col("before") + F.col("rows") > first))
        found = touched.agg(F.min(F.struct("part", "low")).alias("a"), F.max(F.struct("part", "high")).alias("b"), F.min("before").alias("before")).first()
        if found["a"] is None:
            return self.entries.select(*KEY).where(F.lit(False))
        near = self.entries.where(F.col("part").between(found["a"]["part"], found["b"]["part"]))
        low, high = found["a"]["low"], found["b"]["high"]
        near = near.where(_at_least(low) & _at_most(high)).select(*KEY).orderBy(*KEY)
        skip = first - found["before"]
        return (near.offset(skip) if skip else near).limit(last - first + 1)

    def _value_at(self, position: int) -> str:
        return self.entries_at(position, position).first()["value"]

    def _below(self, value: str, equal: bool) -> int:
        """Present entries with a smaller value, or with an equal one too."""
        known = ~F.col("low.absent")
        start = F.col("low.value") <= value if equal else F.col("low.value") < value
        cell = self.cells.where(known & start).agg(F.max(F.struct("before", "part", "low", "high")).alias("c")).first()["c"]
        if cell is None:
            return 0
        inside = self.entries.where((F.col("part") == cell["part"]) & _at_least(cell["low"]) & _at_most(cell["high"]) & ~F.col("absent"))
        return cell["before"] + inside.where(F.col("value") <= value if equal else F.col("value") < value).count()

    def _ranges(self, limit: int, offset: int, down: bool) -> list[tuple[int, int]]:
        """The page as ranges of positions. Downwards, values go down but rows of one value keep their order, so the
        first and the last value of a page give a part of their rows each."""
        rows, present = self.shape["rows"], self.shape["present"]
        end = min(offset + limit, rows)  # behind the page's last place
        if not down or offset >= present:
            return [(offset, end - 1)]
        last = min(end, present) - 1
        top, bottom = self._value_at(present - 1 - offset), self._value_at(present - 1 - last)
        start, stop = self._below(top, False), self._below(top, True)
        local = offset - (present - stop)
        if top == bottom:
            ranges = [(start + local, start + local + last - offset)]
        else:
            low_start, low_stop = self._below(bottom, False), self._below(bottom, True)
            ranges = [(start + local, stop - 1), (low_stop, start - 1)]
            held = sum(b - a + 1 for a, b in ranges)
            ranges.append((low_start, low_start + last - offset - held))
        return ranges + ([(present, end - 1)] if end > present else [])

    def page(self, records: DataFrame, limit: int, offset: int = 0, down: bool = False) -> DataFrame:
        """What ``operators.paging.page_of`` gives for all records sorted by the label."""
        labels, label, total = labels_of(records), self.shape["label"], self.shape["rows"]
        counted = F.lit(total).cast("long")
        if offset >= total or limit <= 0:
            return records.where(F.lit(False)).withColumn(count_name(labels), counted)
        parts = [self.entries_at(a, b).select("rownr") for a, b in self._ranges(limit, offset, down) if b >= a]
        wanted = reduce(DataFrame.unionAll, parts)
        if limit <= LISTED:
            numbers = [r["rownr"] for r in wanted.collect()]
            found = records.where(F.col(ROWNR).isin(numbers))
        else:
            found = records.join(wanted.withColumnRenamed("rownr", ROWNR), ROWNR, "left_semi")
        return found.orderBy(*sort_columns(labels, f"{label},{'desc' if down else 'asc'}")).limit(limit).withColumn(count_name(labels), counted)


def sorted_page(directory: OrderDirectory, records: DataFrame, limit: int, offset: int, sort: str) -> DataFrame:
    """The page for a sort request as in ``_sort``, if the directory is of that column."""
    label, down = sort_key(labels_of(records), sort)
    if label != directory.shape["label"]:
        raise ValueError(f"the directory is of {directory.shape['label']!r}")
    return directory.page(records, limit, offset, down)


def _at_least(key) -> Column:
    """Entries from a key on. Spelled on the value too, so that the reader can skip."""
    if key["absent"]:
        return F.col("absent") & (F.col("rownr") >= key["rownr"])
    same = (F.col("value") == key["value"]) & (F.col("rownr") >= key["rownr"])
    return F.col("absent") | ((F.col("value") >= key["value"]) & (same | (F.col("value") > key["value"])))


def _at_most(key) -> Column:
    if key["absent"]:
        return ~F.col("absent") | (F.col("rownr") <= key["rownr"])
    same = (F.col("value") == key["value"]) & (F.col("rownr") <= key["rownr"])
    return ~F.col("absent") & (F.col("value") <= key["value"]) & (same | (F.col("value") < key["value"]))


def _write(entries: DataFrame, label: str, folder: str, cell_rows: int) -> OrderDirectory:
    spark = entries.sparkSession
    rows, present = entries.agg(F.count(F.lit(1)), F.count_if(~F.col("absent"))).first()
    dealt = entries.repartitionByRange(rows // PARTITION_ROWS + 1, *KEY).sortWithinPartitions(*KEY)
    dealt.withColumn("part", F.spark_partition_id().cast("long")).write.option("maxRecordsPerFile", 0).parquet(f"{folder}/entries")
    stored = spark.read.parquet(f"{folder}/entries")
    index = F.expr(f"_metadata.row_index div {cell_rows}").alias("index")
    key = F.struct(*KEY)
    counted = stored.select("part", index, key.alias("key")).groupBy("part", "index").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    summed = fresh_folder(spark, "cells")
    counted.write.parquet(summed)
    cells = spark.read.parquet(summed)
    parts, most = cells.agg(F.max("part"), F.max("index")).first()
    wide, last = (most or 0) + 1, parts or 0
    numbered = cells.withColumn("cell", F.col("part") * wide + F.col("index")).drop("index")
    placed = with_rows_before(numbered, (last + 1) * wide)
    placed.repartitionByRange((last + 1) * wide // 1_000_000 + 1, "cell").sortWithinPartitions("cell").write.parquet(f"{folder}/cells")
    spark.createDataFrame([(label, rows, present)], "label string, rows long, present long").write.parquet(f"{folder}/shape")
    return OrderDirectory(spark, folder)
