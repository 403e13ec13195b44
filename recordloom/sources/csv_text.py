"""CSV text rules as Column expressions.

A quoted part starts at ``"`` and ends at the next ``"`` that is neither doubled
nor behind a backslash; outside quotes a backslash covers a following ``"`` or
``\\``. All repeats are possessive, so long cells cost no regex stack.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# One complete quoted part, and one escaped character outside quotes.
QUOTED = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
COVERED = r'\\["\\]?+'


def cell_pattern(sep: str) -> str:
    """A cell followed by its separator; group 1 is the raw cell."""
    plain = rf'[^"\\{sep}]*+'
    return rf"(?s)({plain}(?:(?:{COVERED}|{QUOTED}){plain})*+){sep}"


# A cell that is quoted as a whole; blanks before its quote are dropped.
WHOLE_CELL = r'(?s)^\s*+"([^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+)"\z'


def ends_open(line: Column, inside: bool = False) -> Column:
    """Whether a quoted part is still open at the end of a line that starts
    outside or inside one.

    Without backslashes every quote changes sides, a doubled one twice. With
    them, a quote left after taking out all complete parts is an open one.
    """
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    text = F.concat(F.lit('"'), line) if inside else line
    rest = F.regexp_replace(text, rf'(?s)\\["\\]|{QUOTED}', "")
    return (
        F.when(~line.contains('"'), F.lit(inside))
        .when(~line.contains("\\"), quotes % 2 == F.lit(0 if inside else 1))
        .otherwise(rest.contains('"'))
    )


def raw_cells(record: Column, sep: str) -> Column:
    """Cells of a record with their quotes and escapes, as an array."""
    return F.regexp_extract_all(F.concat(record, F.lit(sep)), F.lit(cell_pattern(sep)), F.lit(1))


def cell_value(cell: Column, lone_backslash: str = "keep") -> Column:
    """Text of a raw cell. A backslash before any character but ``"`` and ``\\``
    stays, or goes with ``lone_backslash="drop"``. Cells that are plain, or quoted
    as a whole without backslashes, need no regular expression."""
    covered = r'\\(["\\]?)' if lone_backslash == "drop" else r'\\(["\\])'
    bare = F.regexp_replace(cell, WHOLE_CELL, "$1")
    parsed = F.regexp_replace(bare, covered + r'|"(")', "$1$2")
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    double, single = F.lit('""'), F.lit('"')
    whole = cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1) & ~cell.contains("\\")
    whole = whole & ~F.replace(inner, double, F.lit("")).contains('"')
    plain = ~cell.contains('"') & ~cell.contains("\\")
    return F.when(plain, cell).when(whole, F.replace(inner, double, single)).otherwise(parsed)


def cells(record: Column, sep: str, lone_backslash: str = "keep") -> Column:
    """Cell texts of a record. Records without quotes and backslashes, the usual
    case, are only split."""
    special = record.contains('"') | record.contains("\\")
    parsed = F.transform(raw_cells(record, sep), lambda c: cell_value(c, lone_backslash))
    return F.when(special, parsed).otherwise(F.split(record, re.escape(sep), -1))


def header_cells(record: str, sep: str) -> list[str]:
    """The same for one header record, in Python."""
    if '"' not in record and "\\" not in record:
        return record.split(sep)
    raw = [m.group(1) for m in re.finditer(cell_pattern(sep), record + sep)]
    bare = [re.sub(WHOLE_CELL.replace(r"\z", r"\Z"), r"\1", c) for c in raw]
    return [re.sub(r'\\(["\\])|"(")', lambda m: m.group(1) or m.group(2), c) for c in bare]


# Windows-1252 bytes 80-9F by position; unassigned ones give U+FFFD.
C1_BYTES = "".join(chr(b) for b in range(0x80, 0xA0))
C1_TEXT = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def decoded(value: Column, charset: str) -> Column:
    """Text of a line read as raw bytes; bytes that mean nothing give U+FFFD. Windows-1252 is Latin-1 with other
    characters in 80-9F, which needs no session setting."""
    if charset == "UTF-8":
        return F.make_valid_utf8(value)
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(latin, C1_BYTES, C1_TEXT) if charset == "windows-1252" else latin


def undecodable(line: Column, charset: str) -> Column:
    """Whether a decoded line may hold bytes that mean nothing in its charset."""
    return line.contains("\ufffd")
