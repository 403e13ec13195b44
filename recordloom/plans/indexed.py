"""Side tables of stored datasets, and queries that use them.

Every load of ``MANY_ROWS`` or more rows gets a row directory when it is written. ``index``
adds trigram indexes and order directories; it writes what is missing for the current
loads only, so after an append it reads the new load, and merges orders from their
entries. ``query`` answers like ``Catalog.query``, with whatever side tables there are.

The side tables of a load lie in a folder beside its files and go with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recordloom.operators import fingerprint, paging, predicates
from recordloom.operators.predicates import RESERVED_KEYS
from recordloom.plans.catalog import Catalog
from recordloom.plans.order_directory import OrderDirectory
from recordloom.plans.row_directory import RowDirectory
from recordloom.plans.trigram_index import TrigramIndex
from recordloom.sources.csv_records import scan_csv
from recordloom.sources.records import ROWNR, labels_of, record_schema

MANY_ROWS = 1_000_000


def _named(*names: str) -> str:
    return hashlib.md5("\n".join(names).encode()).hexdigest()


def _side(path: str, kind: str) -> str:
    return f"{path}.side/{kind}"


def _records(catalog: Catalog, segment) -> DataFrame:
    return catalog.spark.read.schema(record_schema(list(segment["labels"]))).parquet(segment["path"])


def row_directory(catalog: Catalog, path: str) -> RowDirectory | None:
    folder = _side(path, "rows")
    return RowDirectory(catalog.spark, folder) if catalog._exists(f"{folder}/shape/_SUCCESS") else None


def write_row_directory(catalog: Catalog, path: str, labels: list[str]) -> RowDirectory:
    records = catalog.spark.read.schema(record_schema(labels)).parquet(path)
    return RowDirectory.write(records, _side(path, "rows"))


def _trigrams(catalog: Catalog, path: str, labels: list[str]) -> TrigramIndex | None:
    folder, rows = _side(path, f"pieces-{_named(*labels)}"), row_directory(catalog, path)
    return TrigramIndex(catalog.spark, folder, rows) if rows and catalog._exists(f"{folder}/labels/_SUCCESS") else None


def _order(catalog: Catalog, paths: list[str], label: str) -> OrderDirectory | None:
    folder = _order_folder(paths, label)
    return OrderDirectory(catalog.spark, folder) if catalog._exists(f"{folder}/shape/_SUCCESS") else None


def _order_folder(paths: list[str], label: str) -> str:
    return _side(paths[-1], f"order-{_named(label, *paths)}")


def _chosen(catalog: Catalog, dataset_id: str) -> list[str]:
    """Columns that ``index`` was asked to index by pieces, of the latest asking."""
    folder = _side(f"{catalog.root}/index/{dataset_id}", "pieces_of")
    return [r["label"] for r in catalog.spark.read.json(folder).collect()] if catalog._exists(f"{folder}/_SUCCESS") else []


def index(catalog: Catalog, name: str, pieces_of: list[str] | None = None, order_by: list[str] | None = None) -> None:
    """Writes what is missing of the row directories, the trigram indexes of ``pieces_of`` and the orders by each of
    ``order_by`` for the loads that make up a dataset."""
    dataset_id = catalog.resolve(name)
    segments = [s for s in catalog.segments(dataset_id) if s["n_rows"]]
    pieces_of = [x.lower() for x in pieces_of or []]
    for segment in segments:
        path, labels = segment["path"], list(segment["labels"])
        rows = row_directory(catalog, path) or write_row_directory(catalog, path, labels)
        if pieces_of and _trigrams(catalog, path, pieces_of) is None:
            folder = _side(path, f"pieces-{_named(*pieces_of)}")
            catalog.remove(folder)
            TrigramIndex.write(_records(catalog, segment), pieces_of, folder, rows)
    if pieces_of:
        told = catalog.spark.createDataFrame([(x,) for x in pieces_of], "label string")
        told.coalesce(1).write.mode("overwrite").json(_side(f"{catalog.root}/index/{dataset_id}", "pieces_of"))
    paths = [s["path"] for s in segments]
    for label in [x.lower() for x in order_by or []]:
        parts = []
        for segment in segments:
            one = _order(catalog, [segment["path"]], label)
            if one is None:
                folder = _order_folder([segment["path"]], label)
                catalog.remove(folder)
                one = OrderDirectory.write(_records(catalog, segment), label, folder)
            parts.append(one)
        if len(parts) > 1 and _order(catalog, paths, label) is None:
            folder = _order_folder(paths, label)
            catalog.remove(folder)
            OrderDirectory.merged(parts, folder)


def _page_in_row_order(catalog: Catalog, segments: list, limit: int, offset: int) -> DataFrame | None:
    """A page of all records from the row directories; None if a load has none or row numbers of loads overlap."""
    directories = [row_directory(catalog, s["path"]) for s in segments]
    if not segments or any(d is None for d in directories):
        return None
    spans = [(d.shape["low"], d.high(), d, s) for d, s in zip(directories, segments)]
    spans.sort(key=lambda x: x[0])
    if any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
        return None
    total, parts, left, at = sum(d.count() for d in directories), [], limit, offset
    for _, _, directory, segment in spans:
        held = directory.count()
        if at < held and left > 0:
            parts.append(directory.rows(_records(catalog, segment), at, left))
            left, at = left - min(left, held - at), 0
        else:
            at -= min(at, held)
    found = reduce(DataFrame.unionByName, parts) if parts else _records(catalog, segments[0]).where(F.lit(False))
    return found.orderBy(ROWNR).withColumn(paging.count_name(labels_of(found)), F.lit(total))


def matching(catalog: Catalog, name: str, request: Mapping[str, str], mode: str = "full") -> DataFrame:
    """The stored records that match, read through the trigram indexes of the loads that have them."""
    dataset_id = catalog.resolve(name)
    records = catalog.records(dataset_id)
    chosen = _chosen(catalog, dataset_id)
    wanted = predicates.bind(labels_of(records), request)
    segments = [s for s in catalog.segments(dataset_id) if s["n_rows"]]
    if not segments or not set(wanted) & set(chosen):
        return predicates.matching(records, request, mode)
    parts = []
    for segment in segments:
        held, own = _trigrams(catalog, segment["path"], chosen), _records(catalog, segment)
        parts.append(held.matching(own, request, mode) if held else predicates.matching(own, request, mode))
    return reduce(DataFrame.unionByName, parts)


def query(catalog: Catalog, name: str, request: Mapping[str, str] | None = None, mode: str = "full", max_limit: int = 100) -> DataFrame:
    """A page for a raw request, reserved keys included: the same rows as ``Catalog.query``."""
    request = dict(request or {})
    dataset_id = catalog.resolve(name)
    tuples = {k: v for k, v in request.items() if k not in RESERVED_KEYS}
    limit, offset = paging.clamp_limit(request.get("_limit"), max_limit), paging.clamp_offset(request.get("_offset"))
    sort = request.get("_sort")
    records = catalog.records(dataset_id)
    segments = [s for s in catalog.segments(dataset_id) if s["n_rows"]]
    if tuples:
        return paging.page_of(matching(catalog, dataset_id, tuples, mode), limit, offset, sort)
    if sort and segments:
        label, down = paging.sort_key(labels_of(records), sort)
        order = _order(catalog, [s["path"] for s in segments], label)
        if order is not None:
            return order.page(records, limit, offset, down)
    found = None if sort else _page_in_row_order(catalog, segments, limit, offset)
    return paging.page_of(records, limit, offset, sort) if found is None else found


def row_count(catalog: Catalog, name: str) -> int:
    """Rows of a dataset, from its log: no record is read."""
    return sum(s["n_rows"] for s in catalog.segments(catalog.resolve(name)))


def table_fingerprint(catalog: Catalog, name: str) -> str:
    """The fingerprint of a dataset, from its log; loads older than fingerprints are read."""
    segments = catalog.segments(catalog.resolve(name))
    return fingerprint.added(s["fingerprint"] or fingerprint.of_table(_records(catalog, s)) for s in segments)


def same_rows(catalog: Catalog, one: str, other: str) -> bool:
    """Whether two datasets hold the same rows equally often, in any order of rows and columns; no record is read."""
    return table_fingerprint(catalog, one) == table_fingerprint(catalog, other)


def loaded_already(catalog: Catalog, name: str, path: str | list[str]) -> bool:
    """Whether one load of a dataset holds exactly the rows of these files: one pass over the files, none over the data."""
    wanted = fingerprint.of_table(scan_csv(catalog.spark, path))
    loads: dict[str, list[str]] = {}
    for s in catalog.segments(catalog.resolve(name)):
        loads.setdefault(s["path"].rsplit("/", 2)[0], []).append(s["fingerprint"] or fingerprint.of_table(_records(catalog, s)))
    return wanted in {fingerprint.added(parts) for parts in loads.values()}
