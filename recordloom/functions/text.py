"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    """``name`` as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def strip_controls(c: Column) -> Column:
    """Cut every character up to U+0020 from both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normal_label(c: Column) -> Column:
    return F.lower(strip_controls(c))


def normal_header(labels: Column) -> Column:
    """Array of raw labels -> trimmed, lower-cased, non-empty, distinct labels."""
    clean = F.transform(labels, normal_label)
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def normal_labels(labels: list[str]) -> list[str]:
    """The same rule for one header row held by the driver."""
    blank = "".join(map(chr, range(0x21)))
    seen = dict.fromkeys(label.strip(blank).lower() for label in labels)
    return [label for label in seen if label]


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a fixed text, not overlapping."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return (gone / F.lit(len(needle))).cast("int")


def is_alphanumeric(c: Column) -> Column:
    """Non-empty and made of letters and digits of any script."""
    return c.rlike(r"^[\p{L}\p{Nd}]+\z")


def json_texts(c: Column) -> Column:
    """JSON array of scalars -> distinct texts."""
    return F.array_distinct(F.from_json(c, "array<string>"))
