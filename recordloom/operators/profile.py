"""Counts, column lists and lengths of a record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.functions.text import col
from recordloom.sources.records import ROWNR, json_column, labels_of


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def first_rownr(df: DataFrame) -> DataFrame:
    return df.agg(F.min(ROWNR).alias("min_rownr"))


def column_names(df: DataFrame) -> DataFrame:
    """Labels present in the first record."""
    first = df.orderBy(ROWNR).limit(1)
    keys = F.json_object_keys(json_column(labels_of(df)))
    return first.select(F.explode(keys).alias("column_name")).distinct()


def all_column_names(df: DataFrame) -> DataFrame:
    """Labels present in any record, from one aggregate pass."""
    labels = labels_of(df)
    seen = df.agg(*[F.max(col(label).isNotNull()).alias(f"seen_{i}") for i, label in enumerate(labels)])
    flags = F.array(*[F.when(F.col(f"seen_{i}"), F.lit(label)) for i, label in enumerate(labels)])
    return seen.select(F.explode(F.array_compact(flags)).alias("column_name"))


def max_lengths(df: DataFrame) -> DataFrame:
    """Longest value of every label in characters; 0 where there is none."""
    labels = labels_of(df)
    longest = df.agg(*[F.coalesce(F.max(F.length(col(label))), F.lit(0)).alias(f"len_{i}") for i, label in enumerate(labels)])
    pairs = F.array(
        *[F.struct(F.lit(label).alias("column_name"), F.col(f"len_{i}").alias("max_length")) for i, label in enumerate(labels)]
    )
    return longest.select(F.inline(pairs))


def lookup_columns(df: DataFrame, longest: int = 256) -> DataFrame:
    """Labels whose values are all short enough for a lookup layout."""
    return max_lengths(df).where(F.col("max_length") <= longest)


def dataset_info(
    records: DataFrame,
    datasets: DataFrame,
    aliases: DataFrame,
    dataset_id: str,
    base_url: str = "",
    context: str | None = None,
) -> DataFrame:
    """One row describing a dataset: status, age, columns, size and names.

    ``datasets`` needs ``id, status, created``; ``aliases`` needs ``dataset_id, alias``.
    ``context`` is passed on as ``@context``. Fixed values: the field names and the time format.
    """
    from recordloom.functions.ids import dataset_url

    labels = labels_of(records)
    names = aliases.where(F.col("dataset_id") == dataset_id).agg(F.array_sort(F.collect_set("alias")))
    rows = records.agg(F.count("*"))
    address = dataset_url(F.lit(base_url), F.col("id"))
    return datasets.where(F.col("id") == dataset_id).select(
        F.col("id").alias("identifier"),
        F.col("status"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ssZ").alias("created"),
        F.array(*[F.lit(label) for label in labels]).alias("columnnames"),
        rows.scalar().alias("rowcount"),
        names.scalar().alias("aliases"),
        address.alias("@id"),
        *([F.lit(context).alias("@context")] if context is not None else []),
    )
