"""Query strings and URL coding on columns of URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordloom.functions.text import strip_controls


def decode(c: Column) -> Column:
    """URL-decoded text; broken escapes give null."""
    return F.try_url_decode(c)


def encode(c: Column) -> Column:
    return F.url_encode(c)


def query_text(url: Column) -> Column:
    """The part of a URL after the first ``?`` and before ``#``; null if none."""
    part = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.when(url.rlike(r"^[^?#]*\?"), part)


def query_parameters(text: Column) -> Column:
    """Query string -> map. Split at ``&`` and the first ``=``, decoded and
    trimmed; no ``=`` gives an empty value, empty keys are skipped and the last
    of several equal keys wins."""

    def pair(item: Column) -> Column:
        cut = F.instr(item, "=")
        key = F.when(cut > 0, F.substring(item, F.lit(1), cut - 1)).otherwise(item)
        value = F.when(cut > 0, F.substring(item, cut + 1, F.length(item))).otherwise(F.lit(""))
        return F.struct(strip_controls(decode(key)).alias("key"), strip_controls(decode(value)).alias("value"))

    pairs = F.filter(F.transform(F.split(text, "&"), pair), lambda p: p["key"].isNotNull() & (p["key"] != ""))
    # Later pairs replace earlier ones without touching the session's map-key policy.
    latest = F.aggregate(
        pairs,
        F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)"),
        lambda done, p: F.concat(F.filter(done, lambda d: d["key"] != p["key"]), F.array(p)),
    )
    return F.map_from_entries(latest)


def page_link(base: Column, offset: Column, limit: Column, others: Column) -> Column:
    """Link to another page of a query; ``others`` is the map of the remaining parameters."""
    extra = F.transform(
        F.map_entries(others),
        lambda e: F.concat(F.lit("&"), encode(e["key"]), F.lit("="), encode(e["value"])),
    )
    head = F.concat(base, F.lit("/json?_offset="), offset.cast("string"), F.lit("&_limit="), limit.cast("string"))
    return F.concat(head, F.array_join(extra, ""))
