"""Set operations on records and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def same_labels(a: list[str], b: list[str]) -> bool:
    return set(a) == set(b)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row telling whether two tables hold the same rows equally often."""
    from recordloom.functions.text import col

    b = b.select(*[col(c) for c in a.columns])
    tagged = a.withColumn("__side", F.lit(1)).unionAll(b.withColumn("__side", F.lit(-1)))
    odd = tagged.groupBy(*[col(c) for c in a.columns]).agg(F.sum("__side").alias("d")).where("d <> 0")
    return odd.agg((F.count("*") == 0).alias("same"))


def shared_keys(keys: Column, columns: Column) -> Column:
    return F.array_intersect(keys, columns)
