"""Record filters: ``{column: value or pattern}`` to one Column predicate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.errors import BadPattern, UnknownColumn
from recordloom.functions import patterns
from recordloom.functions.text import col
from recordloom.sources.records import labels_of

MODES = ("full", "simple", "disabled")

# Request keys that steer the query and never name a column.
RESERVED_KEYS = ("_limit", "_offset", "_sort", "_callback")


def pattern_mode(setting: str | None) -> str:
    """Configuration text to mode: ``simple``; ``full`` or ``true``; else disabled."""
    text = (setting or "").strip().lower()
    if text in ("full", "true"):
        return "full"
    return "simple" if text == "simple" else "disabled"


def bind(columns: list[str], request: Mapping[str, str]) -> dict[str, str]:
    """Request keys to column names. Every key must hit a column of its own."""
    wanted = {k: v for k, v in request.items() if k not in RESERVED_KEYS}
    known = set(columns)
    bound = {k.lower(): v for k, v in wanted.items() if k.lower() in known}
    if len(bound) != len(wanted):
        raise UnknownColumn(f"not columns of this dataset, or named twice: {sorted(wanted)}")
    return bound


def comparison(spark: SparkSession, column: str, value: str, mode: str = "full") -> Column:
    c = col(column)
    if value == "~":
        raise BadPattern("no pattern after ~")
    if mode == "full" and value.startswith("~"):
        return patterns.match(spark, c, value[1:])
    if mode == "full" and patterns.looks_like_pattern(value):
        return patterns.match(spark, c, value)
    if mode == "simple" and value.startswith("^"):
        return patterns.match(spark, c, value)
    return c == F.lit(value)


def predicate(spark: SparkSession, columns: list[str], request: Mapping[str, str], mode: str = "full") -> Column | None:
    """Conjunction over all pairs, or None for an empty request."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parts = [comparison(spark, k, v, mode) for k, v in bind(columns, request).items()]
    return reduce(and_, parts) if parts else None


def matching(df: DataFrame, request: Mapping[str, str], mode: str = "full") -> DataFrame:
    """The records that match every pair; absent values never match."""
    found = predicate(df.sparkSession, labels_of(df), request, mode)
    return df if found is None else df.where(found)


def contains_ignoring_case(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.lower(col(column)).contains(text.lower()))


def equals_ignoring_case(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.lower(col(column)) == text.lower())
