"""Record tables: a row number and one text column per label.

``NULL`` means the label is absent from the record, ``''`` means an empty cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordloom.functions.text import col, quoted

ROWNR = "__rownr"


def labels_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROWNR]


def as_records(df: DataFrame, columns: list[str], rownr: str | None = None) -> DataFrame:
    """Text view of some columns of any table, numbered by an integer column
    that is unique in it, or by scan order if none is given."""
    number = F.col(quoted(rownr)).cast("long") if rownr else F.monotonically_increasing_id()
    return df.select(number.alias(ROWNR), *[col(c).cast("string").alias(c.lower()) for c in columns])


def record_schema(labels: list[str], rownr: bool = True) -> T.StructType:
    fields = [T.StructField(ROWNR, T.LongType())] if rownr else []
    return T.StructType(fields + [T.StructField(label, T.StringType()) for label in labels])


def json_column(labels: list[str]) -> Column:
    """A record as JSON text; absent labels are left out."""
    return F.to_json(F.struct(*[col(label) for label in labels]))


def to_json_records(df: DataFrame) -> DataFrame:
    labels = labels_of(df)
    kept = [F.col(ROWNR)] if ROWNR in df.columns else []
    return df.select(*kept, json_column(labels).alias("data"))


def from_json_records(df: DataFrame, labels: list[str], data: str = "data") -> DataFrame:
    """JSON text back to columns; rows that are not JSON objects are skipped.

    Broken text decodes to a record whose corrupt-text field is filled, so one
    parse gives both the values and the verdict.
    """
    corrupt = "__broken"
    schema = record_schema(labels, rownr=False).add(corrupt, T.StringType())
    parsed = F.from_json(col(data), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    kept = [F.col(ROWNR)] if ROWNR in df.columns else []
    rows = df.select(*kept, parsed.alias("r")).where(F.col("r").isNotNull() & F.col(f"r.{corrupt}").isNull())
    return rows.select(*kept, *[F.col("r." + quoted(label)).alias(label) for label in labels])


def field_text(data: Column, label: str) -> Column:
    """One label of a JSON record as text; null where it is absent."""
    return F.from_json(data, record_schema([label], rownr=False)).getField(label)
