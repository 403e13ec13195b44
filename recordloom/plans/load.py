"""Loading CSV into a dataset: validate and write in one pass, then publish.

A load writes a new Parquet folder and counts rule breaks in the same job. Only
a clean folder is published, by one log entry, so a load shows up as a whole or
not at all and earlier data stay until then.
"""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.errors import LoadRejected, RecordError
from recordloom.operators import fingerprint, registry
from recordloom.operators.sets import same_labels
from recordloom.plans import indexed
from recordloom.plans.catalog import Catalog
from recordloom.sources.csv_records import parse
from recordloom.sources.records import ROWNR, labels_of
from recordloom.sources.sniff import LONGEST_LOOKUP, FileGroup, charset_votes, file_groups

# Times a load is tried again because Spark split the input differently while reading it twice.
SPLIT_TRIES = 3


def lookup_options(columns: list[str]) -> dict[str, str]:
    """Parquet writer options for equality lookups on some columns.

    A filter takes the size that the number of distinct values needs, from 4 KiB
    up; a writer holds at most some 64 MiB for the filters of all columns.
    """
    if not columns:
        return {}
    most = max(4096, min(2**20, 2**25 // len(columns)))
    shared = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(most)}
    each = [{f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.candidates.number#{c}": "9"} for c in columns]
    return reduce(dict.__or__, each, shared)


def write_records(df: DataFrame, path: str, lookup: list[str] | None = None) -> None:
    df.write.options(**lookup_options(lookup or [])).parquet(path)


def write_lookup_layout(df: DataFrame, path: str, sort_by: str | None = None) -> list[str]:
    """Write records with bloom filters on every column short enough; its names.
    ``sort_by`` orders rows within files so that ranges of that column are skipped."""
    from recordloom.operators.profile import lookup_columns
    from recordloom.functions.text import col

    columns = [r["column_name"] for r in lookup_columns(df, LONGEST_LOOKUP).collect()]
    out = df.sortWithinPartitions(col(sort_by), ROWNR) if sort_by else df
    write_records(out, path, columns)
    return columns


class OtherCharset(Exception):
    """Some files are not in the charset that their heads show."""

    def __init__(self, known: dict[str, str]):
        super().__init__()
        self.known = known


def _write_group(
    catalog: Catalog, group: FileGroup, labels: list[str], path: str, base: int, lone_backslash: str
) -> dict:
    """Write one file group; plan again where the first look was wrong.

    Each new plan settles one more question for good, so their number is bounded by
    the questions; only a scan that was split differently is tried again as it is.
    """
    joined, exact, numbers = group.quoted_newlines, "\n" in group.header, False
    lookup, settled = [x for x in labels if x not in group.long_labels], group.settled or group.charset not in ("UTF-8", "windows-1252")
    attempt = strays = 0
    while strays < SPLIT_TRIES:
        target = f"{path}/part{attempt}"
        parsed = parse(catalog.spark, group, labels, joined, exact, base, lone_backslash, exact_numbers=numbers)
        write_records(parsed.rows, target, lookup)
        facts = parsed.facts()
        for folder in parsed.temporary:
            catalog.remove(folder)
        attempt += 1
        long = {x for i, x in enumerate(labels) if (facts[f"len_{i}"] or 0) > LONGEST_LOOKUP}
        if facts["undecodable"] and not settled and not facts["stray"]:
            known = charset_votes(catalog.spark, [p for p, _ in group.files])
            if any(c != group.charset for c in known.values()):
                raise OtherCharset(known)
            settled = True
        if facts["stray"]:
            strays += 1
        elif not joined and facts["open"]:
            joined = True
        elif not exact and facts["heads"] != len(group.files):
            exact = True
        elif facts["heads"] != len(group.files):
            raise LoadRejected("a file does not start with the header that its head shows")
        elif not numbers and facts["crowded"]:
            numbers = True
        elif long & set(lookup):
            lookup = [x for x in lookup if x not in long]
        else:
            return {"path": target, **facts}
        catalog.remove(target)
    raise LoadRejected("the input was split differently each time it was read")


def load_csv(
    catalog: Catalog,
    dataset_id: str,
    path: str | list[str],
    mode: str = "append",
    lone_backslash: str = "keep",
    source: str | None = None,
    charset: str | None = None,
    sep: str | None = None,
) -> int:
    """Load files into a dataset and return its new status.

    ``charset`` (a name as in ``sniff.MARKS``, or "windows-1252") and ``sep`` are told
    from the files if not given. Bytes without meaning in a file's charset become
    U+FFFD; a warning tells how many lines may hold some.

    ``append`` needs the same column set as the stored data; ``replace`` takes
    any. Broken input sets the status to Error and changes nothing else.
    ``source`` is a name kept with the load, see ``Catalog.loaded_from``.
    """
    if mode not in ("append", "replace"):
        raise ValueError("mode must be append or replace")
    spark = catalog.spark
    catalog.set_status(dataset_id, registry.PROCESSING)
    try:
        _load(catalog, spark, dataset_id, path, mode, lone_backslash, source, charset, sep)
    except RecordError:
        catalog.set_status(dataset_id, registry.ERROR)
        return registry.ERROR
    except Exception:
        catalog.set_status(dataset_id, registry.ERROR)
        raise
    catalog.set_status(dataset_id, registry.AVAILABLE)
    return registry.AVAILABLE


def _load(
    catalog: Catalog,
    spark: SparkSession,
    dataset_id: str,
    path: str | list[str],
    mode: str,
    lone_backslash: str,
    source: str | None,
    charset: str | None,
    sep: str | None,
    known: dict[str, str] | None = None,
) -> None:
    groups = file_groups(spark, path, charset, sep, known)
    labels = list(groups[0].labels)
    segments = catalog.segments(dataset_id)
    if mode == "append" and any(s["n_rows"] for s in segments):
        stored = list(segments[0]["labels"])
        if not same_labels(stored, labels):
            raise LoadRejected(f"columns {labels} do not match the stored columns {stored}")
        labels = stored
    elif mode == "append":
        mode = "replace"  # nothing stored yet: any structure will do
    base = max((s["next_rownr"] for s in segments), default=0)

    table = "data_" + dataset_id.replace("-", "")
    folder = f"{catalog.data_folder(table)}/load-{uuid.uuid4().hex}"
    try:
        facts = [
            _write_group(catalog, g, labels, f"{folder}/group{i}", base, lone_backslash) for i, g in enumerate(groups)
        ]
        too_long = sum(f["overlong"] for f in facts)
        if too_long:
            raise LoadRejected(f"{too_long} rows have more values than the header has labels")
        for f in facts:
            if f["rows"] >= indexed.MANY_ROWS:
                indexed.write_row_directory(catalog, f["path"], labels)
    except OtherCharset as found:  # more files are settled now, so this ends
        catalog.remove(folder)
        return _load(catalog, spark, dataset_id, path, mode, lone_backslash, source, charset, sep, {**(known or {}), **found.known})
    except Exception:
        catalog.remove(folder)
        raise
    broken = sum(f["undecodable"] for f in facts)
    if broken:
        warnings.warn(f"{broken} lines hold characters that stand for bytes without meaning", stacklevel=3)
    next_rownr = max((f["max_rownr"] for f in facts if f["max_rownr"] is not None), default=base - 1) + 1
    loads = [
        {
            "mode": mode if i == 0 else "append",
            "path": f["path"],
            "labels": labels,
            "n_rows": f["rows"],
            "next_rownr": next_rownr,
            "long_values": [f[f"len_{j}"] or 0 for j in range(len(labels))],
            "source": source,
            "fingerprint": fingerprint.from_sums(f["rows"], f),
        }
        for i, f in enumerate(facts)
    ]
    catalog.publish(dataset_id, loads)


def create_from_csv(
    catalog: Catalog, path: str | list[str], lone_backslash: str = "keep", charset: str | None = None, sep: str | None = None
) -> tuple[str, int]:
    """New dataset from files: ``(id, status)``."""
    dataset_id = catalog.create()
    catalog.set_status(dataset_id, registry.ACCEPTED)
    return dataset_id, load_csv(catalog, dataset_id, path, "append", lone_backslash, charset=charset, sep=sep)


def append_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both record tables as one, matched by label, the new rows numbered after the old."""
    if not same_labels(labels_of(old), labels_of(new)):
        raise LoadRejected("the column sets differ")
    last = old.agg(F.max(ROWNR)).scalar()
    shifted = new.withColumn(ROWNR, F.col(ROWNR) + F.coalesce(last, F.lit(-1)) + 1)
    return reduce(DataFrame.unionByName, [old, shifted])
