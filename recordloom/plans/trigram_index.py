"""A side index of three-character pieces, for patterns that are not anchored.

Statistics and bloom filters help values and prefixes only. This index holds, for each
indexed column, which cells of the row directory hold which pieces. A request is turned
into a condition on pieces (``functions.grams``), the condition into cells, and those into
ranges of row numbers, which the Parquet reader compares with its statistics: row
groups in no range are not read. The request itself is then evaluated as ever, so
the result is the same; a pattern that asks for no piece scans the table.

Pieces are collected cell by cell in the tasks that read the records, as numbers, and
sorted by column and piece; a question reads the row groups of its pieces.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.functions import grams, patterns
from recordloom.functions.text import col
from recordloom.operators import predicates
from recordloom.plans.row_directory import RowDirectory
from recordloom.sources.records import ROWNR

MOST_RANGES = 500  # ranges of row numbers in a filter; more cells are put together
INDEXED_ROWS = 100_000  # records whose pieces go to one partition of the index


def _codes(text: str) -> np.ndarray:
    """The pieces of a text as numbers."""
    chars = np.frombuffer(grams.fold(text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(chars) < grams.SIZE:
        return np.empty(0, np.int64)
    return (chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:]


class TrigramIndex:
    """The index of some columns of a table of records, beside its row directory."""

    def __init__(self, spark: SparkSession, folder: str, rows: RowDirectory):
        self.spark, self.folder, self.rows = spark, folder, rows
        self.postings = spark.read.parquet(f"{folder}/postings")
        self.labels = [r["label"] for r in spark.read.parquet(f"{folder}/labels").collect()]

    @staticmethod
    def write(records: DataFrame, labels: list[str], folder: str, rows: RowDirectory) -> TrigramIndex:
        spark = records.sparkSession
        low, width = rows.shape["low"], rows.shape["width"]

        def collect(batches):
            held: dict[tuple[int, int], list[np.ndarray]] = {}
            size = 0

            def flush():
                for (cell, label), codes in held.items():
                    found = np.unique(np.concatenate(codes))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), label, np.int32)), pa.array(found), pa.array(np.full(len(found), cell, np.int64))], ["label", "piece", "cell"])
                held.clear()

            for batch in batches:
                cells = (batch.column(0).to_numpy(zero_copy_only=False) - low) // width
                edges = np.flatnonzero(np.diff(cells)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
                    for label in range(len(labels)):
                        texts = [t.as_py() for t in batch.column(label + 1).slice(a, b - a) if t.is_valid]
                        codes = _codes("\0\0\0".join(texts)) if texts else np.empty(0, np.int64)
                        if len(codes):
                            codes = np.unique(codes)
                            held.setdefault((int(cells[a]), label), []).append(codes)
                            size += len(codes)
                if size > 2_000_000:
                    yield from flush()
                    size = 0
            yield from flush()

        found = records.select(ROWNR, *[col(x) for x in labels]).mapInArrow(collect, "label int, piece long, cell long")
        parts = max(1, rows.count() // INDEXED_ROWS)
        found.repartitionByRange(parts, "label", "piece").sortWithinPartitions("label", "piece", "cell").write.parquet(f"{folder}/postings")
        spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "number int, label string").coalesce(1).orderBy("number").write.parquet(f"{folder}/labels")
        return TrigramIndex(spark, folder, rows)

    # -- questions -----------------------------------------------------------

    def _cells_with(self, label: str, condition) -> DataFrame | None:
        """Cells that meet a condition on the pieces of a column; None if the condition says nothing."""
        wanted = grams.pieces_of(condition)
        if not wanted or label not in self.labels:
            return None
        codes = {p: grams.code(p) for p in wanted}
        held = self.postings.where((F.col("label") == self.labels.index(label)) & F.col("piece").isin(list(codes.values())))
        pieces = held.groupBy("cell").agg(F.collect_set("piece").alias("pieces"))

        def met(c) -> Column:
            if isinstance(c, str):
                return F.array_contains("pieces", F.lit(codes[c]).cast("long"))
            whole = F.lit(isinstance(c, grams.All))
            for part in c.parts:
                whole = (whole & met(part)) if isinstance(c, grams.All) else (whole | met(part))
            return whole

        return pieces.where(met(condition)).select("cell")

    def _condition(self, value: str, mode: str):
        if (mode == "full" and value.startswith("~")) or (mode == "full" and patterns.looks_like_pattern(value)) or (mode == "simple" and value.startswith("^")):
            return grams.required(value[1:] if mode == "full" and value.startswith("~") else value)
        return grams.pieces(value)

    def ranges(self, conditions: list[tuple[str, object]]) -> list[tuple[int, int]] | None:
        """Ranges of row numbers outside of which no record meets the conditions, at most MOST_RANGES; None: no bound."""
        found = None
        for label, condition in conditions:
            cells = self._cells_with(label, condition)
            if cells is not None:
                found = cells if found is None else found.join(cells, "cell", "left_semi")
        if found is None:
            return None
        placed = self.rows.cells.select("cell", "low", "high").join(found, "cell", "left_semi")
        lowest, highest, n = placed.agg(F.min("cell"), F.max("cell"), F.count(F.lit(1))).first()
        if not n:
            return []
        step = 1 if n <= MOST_RANGES else (highest - lowest) // MOST_RANGES + 1
        group = F.expr(f"(cell - {lowest}L) div {step}L").alias("group")
        spans = placed.groupBy(group).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        out: list[tuple[int, int]] = []
        for low, high in sorted((r["low"], r["high"]) for r in spans.collect()):  # MOST_RANGES + 1 rows at most
            if out and low <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return out

    def narrowed(self, records: DataFrame, conditions: list[tuple[str, object]]) -> DataFrame:
        """The records in the ranges that the conditions leave."""
        ranges = self.ranges(conditions)
        if ranges is None:
            return records
        inside = [F.col(ROWNR).between(low, high) if low < high else F.col(ROWNR) == low for low, high in ranges]
        while len(inside) > 1:  # a balanced tree: a chain of hundreds would be deep
            inside = [inside[i] | inside[i + 1] if i + 1 < len(inside) else inside[i] for i in range(0, len(inside), 2)]
        return records.where(inside[0] if inside else F.lit(False))

    def matching(self, records: DataFrame, request: Mapping[str, str], mode: str = "full") -> DataFrame:
        """What ``operators.predicates.matching`` gives, reading only where the request can be met."""
        found = predicates.matching(records, request, mode)  # checks the request too
        bound = predicates.bind([c for c in records.columns if c != ROWNR], request)
        near = self.narrowed(records, [(label, self._condition(value, mode)) for label, value in bound.items()])
        return found if near is records else predicates.matching(near, request, mode)

    def contains_ignoring_case(self, records: DataFrame, column: str, text: str) -> DataFrame:
        near = self.narrowed(records, [(column.lower(), grams.pieces(text.lower(), ignore_case=True))])
        return predicates.contains_ignoring_case(near, column, text)
