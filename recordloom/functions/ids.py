"""Identifiers: hashes, UUIDs, table, index and dataset names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UUID_SHAPE = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"


def md5_hex(c: Column) -> Column:
    return F.md5(c)


def sha1_hex(c: Column) -> Column:
    return F.sha1(c)


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID_SHAPE)


def new_id() -> Column:
    """A random UUID per row."""
    return F.expr("uuid()")


def table_name(dataset_id: Column) -> Column:
    return F.concat(F.lit("data_"), F.replace(dataset_id, F.lit("-"), F.lit("")))


def index_name(table: Column, column: Column) -> Column:
    return F.concat(table, F.lit("_jsonidx_"), F.substring(F.md5(column), 1, 8))


def dataset_url(base: Column, dataset_id: Column) -> Column:
    """Base address, one slash, ``dataset/<id>``."""
    slash = F.when(base.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.concat(base, slash, F.lit("dataset/"), dataset_id)
