"""Ordered pages of a result, with the total match count beside them."""

from __future__ import annotations

import os.path
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordloom.errors import BadNumber, UnknownColumn
from recordloom.functions.text import col
from recordloom.functions.web import page_link
from recordloom.operators.predicates import RESERVED_KEYS, matching
from recordloom.sources.records import ROWNR, labels_of

DEFAULT_LIMIT = 100

# Largest offset served by a top-k operator, which holds offset + limit rows in
# memory. Beyond it the page's place is found from counts, see ``_skip_by_counts``.
SHALLOW_OFFSET = 50_000
COUNT_CELLS = 4096


def _integer(value: int | str, bits: int = 32) -> int:
    if isinstance(value, bool) or not re.fullmatch(r"[+-]?[0-9]+", str(value)) or abs(int(value)) >= 2 ** (bits - 1):
        raise BadNumber(f"not an integer: {value!r}")
    return int(value)


def clamp_limit(value: int | str | None, maximum: int = DEFAULT_LIMIT) -> int:
    """1..maximum is used; any other number gives the default."""
    if value is None:
        return DEFAULT_LIMIT
    n = _integer(value)
    return n if 0 < n <= maximum else DEFAULT_LIMIT


def clamp_offset(value: int | str | None) -> int:
    """Any long: pages far behind the start are found from counts."""
    return max(_integer(value, 64), 0) if value is not None else 0


def count_name(labels: list[str]) -> str:
    """The column of a page that carries the total: the usual name behind as many pairs of
    underscores as it takes to be no label."""
    name = "result_count"
    while name in labels:
        name = "__" + name
    return name


def counted_by(page: DataFrame) -> str:
    """The column of a page that carries the total: of the names in question the one that was added last."""
    return [c for c in page.columns if re.fullmatch("(__)*result_count", c)][-1]


def sort_key(labels: list[str], sort: str) -> tuple[str, bool]:
    """``"Label,asc"`` or ``"Label,desc"`` to a label and whether it goes down."""
    name, _, way = sort.rpartition(",")
    if way.strip().lower() not in ("asc", "desc"):
        name, way = sort, "asc"
    name = name.strip().lower()
    if name not in labels:
        raise UnknownColumn(f"cannot sort by {name!r}")
    return name, way.strip().lower() == "desc"


def sort_columns(labels: list[str], sort: str | None) -> list[Column]:
    """Ties and the default keep row order; absent values come last."""
    if not sort:
        return [F.col(ROWNR)]
    name, down = sort_key(labels, sort)
    return [col(name).desc_nulls_last() if down else col(name).asc_nulls_last(), F.col(ROWNR)]


def _skip_by_counts(matches: DataFrame, offset: int) -> tuple[DataFrame, int]:
    """Cut off leading row numbers holding fewer than ``offset`` matches.

    Row numbers are split into equal cells and counted (a partial aggregate,
    at most COUNT_CELLS result rows), then the cell holding the page start is
    split again until few enough rows are left to skip.
    """
    low, high = matches.agg(F.min(ROWNR), F.max(ROWNR)).first()
    while low is not None and offset > SHALLOW_OFFSET and high > low:
        width = (high - low) // COUNT_CELLS + 1
        cell = F.expr(f"({ROWNR} - {low}L) div {width}L")
        inside = matches.where((F.col(ROWNR) >= low) & (F.col(ROWNR) <= high))
        counts = sorted(map(tuple, inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()))
        start = None
        for number, n in counts:
            if offset < n:
                start = number
                break
            offset -= n
        if start is None:
            return matches.where(F.lit(False)), 0
        low, high = low + start * width, min(high, low + (start + 1) * width - 1)
    if offset > SHALLOW_OFFSET:  # one row at most is left, and more are to be skipped
        return matches.where(F.lit(False)), 0
    return (matches if low is None else matches.where(F.col(ROWNR) >= low)), offset


def _skip_by_values(matches: DataFrame, label: str, down: bool, offset: int) -> tuple[DataFrame, int]:
    """The same for pages sorted by a text column: values are counted by their
    next character until the page start is known closely enough. Each step
    returns one row per distinct character."""
    c, order = col(label), (lambda g: g["ch"])
    absent = matches.where(c.isNull())
    rows, prefix = matches.where(c.isNotNull()), ""
    while offset > SHALLOW_OFFSET:
        group = F.substring(c, len(prefix) + 1, 1).alias("ch")
        counts = rows.where(c.startswith(prefix)).groupBy(group).agg(
            F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")
        )
        found = None
        for g in sorted(counts.collect(), key=order, reverse=down):
            if offset < g["n"]:
                found = g
                break
            offset -= g["n"]
        if found is None:  # past all values: only rows without one are left
            return _skip_by_counts(absent, offset)
        onward = c <= found["high"] if down else c >= found["low"]
        if found["low"] == found["high"]:
            same, offset = _skip_by_counts(rows.where(c == found["low"]), offset)
            beyond = rows.where(c < found["low"] if down else c > found["low"])
            return same.unionAll(beyond).unionAll(absent), offset
        prefix = os.path.commonprefix([found["low"], found["high"]])
        kept = rows.where(onward)
        if offset <= SHALLOW_OFFSET:
            return kept.unionAll(absent), offset
        rows = kept
    return matches, offset


def page_of(matches: DataFrame, limit: int, offset: int = 0, sort: str | None = None) -> DataFrame:
    """One page of ``matches`` in order, each row carrying ``result_count`` (see ``count_name``).

    The count is a scalar subquery, so it reads only the filter columns and the
    rows are never gathered in one partition. A page past the end has no rows.
    """
    total = matches.agg(F.count("*")).scalar()
    order = sort_columns(labels_of(matches), sort)
    rows, skip = matches, offset
    if offset > SHALLOW_OFFSET:
        if sort:
            label, down = sort_key(labels_of(matches), sort)
            rows, skip = _skip_by_values(matches, label, down, offset)
        else:
            rows, skip = _skip_by_counts(matches, offset)
    rows = rows.orderBy(*order)
    if skip:
        rows = rows.offset(skip)
    return rows.limit(limit).withColumn(count_name(labels_of(matches)), total)


def query(
    df: DataFrame,
    request: Mapping[str, str] | None = None,
    limit: int | str | None = None,
    offset: int | str | None = None,
    sort: str | None = None,
    mode: str = "full",
    max_limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Filter, order and page a record table."""
    found = matching(df, request or {}, mode)
    return page_of(found, clamp_limit(limit, max_limit), clamp_offset(offset), sort)


def query_request(df: DataFrame, request: Mapping[str, str], mode: str = "full", max_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The same for a raw request whose reserved keys carry limit, offset and sort."""
    return query(
        df,
        {k: v for k, v in request.items() if k not in RESERVED_KEYS},
        request.get("_limit"),
        request.get("_offset"),
        request.get("_sort"),
        mode,
        max_limit,
    )


def envelope(
    page: DataFrame,
    limit: int,
    offset: int = 0,
    query_time_ms: int | None = None,
    base_url: str | None = None,
    others: Mapping[str, str] | None = None,
    sort: str | None = None,
) -> DataFrame:
    """One row around a page: results, counts and where the neighbours start.

    Gathers at most ``limit`` rows. With ``base_url`` the neighbour links are
    spelled out too.
    """
    counted = counted_by(page)
    labels = [c for c in labels_of(page) if c != counted]
    record = F.struct(*[col(label) for label in labels])
    place = F.struct(F.row_number().over(_page_window(labels, sort)).alias("i"), record.alias("r"))
    rows = page.select(place.alias("p"), F.col(counted).alias("result_count"))
    whole = rows.agg(
        F.transform(F.array_sort(F.collect_list("p")), lambda p: p["r"]).alias("results"),
        F.coalesce(F.max("result_count"), F.lit(0)).cast("long").alias("result_count"),
    )
    out = whole.select(
        "results",
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        "result_count",
        F.lit(query_time_ms).cast("long").alias("query_time"),
        F.when(F.lit(offset - limit >= 0), F.lit(offset - limit)).alias("prev_offset"),
        F.when(F.col("result_count") >= limit + offset, F.lit(limit + offset)).alias("next_offset"),
    )
    if base_url is None:
        return out
    pairs = [F.lit(x) for k, v in (others or {}).items() if k not in ("_limit", "_offset") for x in (k, v)]
    rest = F.create_map(*pairs) if pairs else F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    for side in ("prev", "next"):
        at = F.col(f"{side}_offset")
        out = out.withColumn(side, F.when(at.isNotNull(), page_link(F.lit(base_url), at, F.lit(limit), rest)))
    return out


def _page_window(labels: list[str], sort: str | None):
    from pyspark.sql import Window

    # Over one page of at most ``limit`` rows only.
    return Window.orderBy(*sort_columns(labels, sort))
