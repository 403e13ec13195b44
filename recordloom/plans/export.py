"""Writing whole datasets as JSON or CSV, one file per partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.functions.text import col
from recordloom.sources.records import ROWNR, json_column, labels_of


def _rows(df: DataFrame, ordered: bool) -> DataFrame:
    return df.orderBy(ROWNR) if ordered else df


def write_json_lines(df: DataFrame, path: str, ordered: bool = False) -> None:
    """One JSON object per line. ``ordered`` sorts by row number across files,
    which costs a range shuffle; without it rows keep their order in a file."""
    _rows(df, ordered).select(json_column(labels_of(df)).alias("value")).write.text(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array around the records of a partition; one record waits for its successor."""
    waiting, lead = None, "["
    for batch in batches:
        lines = []
        for record in batch["value"].to_pylist():
            if waiting is not None:
                lines.append(f"{lead}{waiting},")
                lead = ""
            waiting = record
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array([f"{lead}{waiting}]" if waiting is not None else "[]"])], ["value"])


def write_json_array(df: DataFrame, path: str, ordered: bool = False) -> None:
    """One JSON array per file, written by the executors."""
    records = _rows(df, ordered).select(json_column(labels_of(df)).alias("value"))
    records.mapInArrow(_bracketed, "value string").write.text(path)


def write_csv(df: DataFrame, path: str, ordered: bool = False, sep: str = ",", escape_backslash: bool = False, charset: str = "UTF-8") -> None:
    """Header and rows in every file; quotes only where needed; absent cells empty.
    ``escape_backslash`` doubles backslashes so that a load reads them back."""
    labels = labels_of(df)
    out = _rows(df, ordered).select(*[col(label) for label in labels])
    if escape_backslash:
        out = out.select(*[F.replace(col(label), F.lit("\\"), F.lit("\\\\")).alias(label) for label in labels])
    writer = out.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    writer = writer.option("emptyValue", "").option("nullValue", "").option("encoding", charset)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
