"""Where rows lie: counts per cell of row numbers, with the rows before each cell.

A load's rows are numbered upwards but with gaps, so a position says nothing about a
number. The directory cuts the numbers into cells of equal width, with about ``CELL_ROWS``
rows each where there are rows (files leave wide gaps between them), and keeps for every cell that has rows how many, which first and last
number, and how many rows come before it. Two questions are then answered by a
comparison that the Parquet reader evaluates on the few columns of this small table:

- ``select``: which row numbers hold the rows from some position on,
- ``rank``: how many rows come before a row number.

A page at any position reads the row groups of its cells and nothing else, and the
count of all rows reads no record.

Counting reads one column and shuffles one row per cell. The sums are carried up and
down a tree of ``FAN`` cells a node, so no task ever holds more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recordloom.session import fresh_folder
from recordloom.sources.records import ROWNR, labels_of

CELL_ROWS = 8192
STRETCH = 1024  # row numbers; stretches in use tell how dense numbers are where there are any
FAN = 1024


def with_rows_before(cells: DataFrame, top: int) -> DataFrame:
    """Adds ``before``, the sum of ``rows`` over all smaller ``cell`` numbers, which go from 0 to ``top``."""
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    if top < FAN:  # FAN rows at most in the one task that sums them up
        return cells.withColumn("before", F.coalesce(F.sum("rows").over(earlier), nothing))
    node = F.expr(f"cell div {FAN}")
    nodes = with_rows_before(cells.groupBy(node.alias("cell")).agg(F.sum("rows").alias("rows")), top // FAN)
    nodes = nodes.select(F.col("cell").alias("__node"), F.col("before").alias("__node_before"))
    placed = cells.withColumn("__node", node).join(nodes, "__node")
    within = Window.partitionBy("__node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__node_before") + F.coalesce(F.sum("rows").over(within), nothing)
    return placed.withColumn("before", before).drop("__node", "__node_before")


class RowDirectory:
    """The directory of a table of records, kept in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.cells = spark.read.parquet(f"{folder}/cells")
        self.shape = spark.read.parquet(f"{folder}/shape").first()  # one row: low, high, width, rows

    @staticmethod
    def write(records: DataFrame, folder: str, cell_rows: int = CELL_ROWS) -> RowDirectory:
        spark = records.sparkSession
        used = F.approx_count_distinct(F.expr(f"{ROWNR} div {STRETCH}"))
        low, high, rows, stretches = records.agg(F.min(ROWNR), F.max(ROWNR), F.count(F.lit(1)), used).first()
        low, high = low or 0, high or 0
        width = max(1, cell_rows * stretches * STRETCH // max(rows, 1))
        cell = F.expr(f"({ROWNR} - {low}L) div {width}L").alias("cell")
        counted = records.select(ROWNR).groupBy(cell).agg(F.count(F.lit(1)).alias("rows"), F.min(ROWNR).alias("low"), F.max(ROWNR).alias("high"))
        summed, top = fresh_folder(spark, "cells"), (high - low) // width
        counted.write.parquet(summed)
        placed = with_rows_before(spark.read.parquet(summed), top)
        placed.repartitionByRange(top // 1_000_000 + 1, "cell").sortWithinPartitions("cell").write.parquet(f"{folder}/cells")
        spark.createDataFrame([(low, high, width, rows)], "low long, high long, width long, rows long").write.parquet(f"{folder}/shape")
        return RowDirectory(spark, folder)

    def count(self) -> int:
        return self.shape["rows"]

    def high(self) -> int:
        """The last row number."""
        return self.shape["high"]

    def select(self, position: int, rows: int) -> tuple[int, int, int] | None:
        """(first number, last number, rows to skip): a range of row numbers that has the ``rows`` rows from
        ``position`` on and at most a cell more on each side; None past the end."""
        if position >= self.count() or rows <= 0:
            return None
        touched = self.cells.where((F.col("before") < position + rows) & (F.col("before") + F.col("rows") > position))
        first = touched.agg(F.min("low"), F.max("high"), F.min("before")).first()
        return first[0], first[1], position - first[2]

    def rank(self, rownr: int, records: DataFrame) -> int:
        """How many rows come before a row number, which need not be in use."""
        at = self.cells.where(F.col("low") < rownr).agg(F.max(F.struct("low", "high", "before", "rows")).alias("c")).first()["c"]
        if at is None:
            return 0
        if at["high"] < rownr:
            return at["before"] + at["rows"]
        return at["before"] + records.where((F.col(ROWNR) >= at["low"]) & (F.col(ROWNR) < rownr)).count()

    def rows(self, records: DataFrame, position: int, rows: int) -> DataFrame:
        """The ``rows`` records from ``position`` on, in row order."""
        place = self.select(position, rows)
        if place is None:
            return records.where(F.lit(False))
        low, high, skip = place
        near = records.where((F.col(ROWNR) >= low) & (F.col(ROWNR) <= high)).orderBy(ROWNR)
        return (near.offset(skip) if skip else near).limit(rows)

    def page(self, records: DataFrame, limit: int, offset: int = 0) -> DataFrame:
        """What ``operators.paging.page_of`` gives for all records."""
        from recordloom.operators.paging import count_name

        return self.rows(records, offset, limit).withColumn(count_name(labels_of(records)), F.lit(self.count()))
