"""What a CSV file looks like: charset, separator, header and labels.

Heads are read on the executors, one bounded read per file.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.errors import LoadRejected
from recordloom.functions.text import normal_labels
from recordloom.sources.csv_text import header_cells

# Fixed value: bytes looked at to tell the charset.
HEAD_BYTES = 524_288

# A header must end within this many bytes; a file with a longer one is refused.
LONGEST_HEAD = 64 * 1024 * 1024

# Fixed value: columns with longer values get no lookup layout.
LONGEST_LOOKUP = 256

# Byte-order marks, longest first.
MARKS = [
    (codecs.BOM_UTF32_LE, "UTF-32LE"),
    (codecs.BOM_UTF32_BE, "UTF-32BE"),
    (codecs.BOM_UTF8, "UTF-8"),
    (codecs.BOM_UTF16_LE, "UTF-16LE"),
    (codecs.BOM_UTF16_BE, "UTF-16BE"),
]
SCHEMA = "path string, size long, charset string, sep string, header string, open boolean, problem string, long array<int>"
_RECORD = re.compile(r'(?s)((?:[^"\n\\]|\\["\\]?+|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+")*+)(?:\n|\Z)')


def charset_of(head: bytes) -> str:
    """A first guess: byte-order mark, else valid UTF-8, else Windows-1252. A character
    cut off at the end of the head is not held against UTF-8. ``charset_votes`` has the
    last word for files without a mark."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=len(head) < HEAD_BYTES)
        return "UTF-8"
    except UnicodeDecodeError:
        return "windows-1252"


def separator_of(line1: str, line2: str | None) -> str:
    """``;`` if the first two physical lines hold it equally often, else ``,``."""
    n = line1.count(";")
    return ";" if line2 is not None and n and n == line2.count(";") else ","


def separator_column(line1: Column, line2: Column) -> Column:
    from recordloom.functions.text import count_of

    n1, n2 = count_of(line1, ";"), count_of(line2, ";")
    return F.when((n1 > 0) & (n1 == n2), ";").otherwise(",")


def head_facts(head: bytes, complete: bool, charset: str) -> tuple[str | None, str | None, bool, str | None] | None:
    """(separator, header record, quoted newline seen, problem); None if more bytes are needed.
    A file of one line tells no separator."""
    text = head.decode("cp1252" if charset == "windows-1252" else charset, errors="replace").lstrip("\ufeff")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n", 2)
    if len(lines) < 3 and not complete:
        return None
    if len(lines) == 2 and lines[1] == "":
        lines = lines[:1]
    found = _RECORD.match(text)
    if not found:
        if not complete:
            return None
        return separator_of(lines[0], None), None, False, "the header has a quote that is not closed"
    last = text.rfind("\n")
    body = text if complete or last < 0 else text[:last]
    seen = re.sub(r'(?s)\\["\\]|"[^"\\\n]*+(?:(?:\\.|"")[^"\\\n]*+)*+"', "", body)
    return separator_of(*lines[:2]) if len(lines) > 1 else None, found.group(1), '"' in seen, None


def _open(path: str):
    """A byte stream for a path as Spark names it."""
    from pyarrow import fs

    if "://" not in path:
        scheme, _, rest = path.rpartition(":")
        path = rest if scheme in ("", "file") else path
        return fs.LocalFileSystem().open_input_stream(path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    system, inner = fs.FileSystem.from_uri(path) if not path.startswith("file://") else (fs.LocalFileSystem(), path[7:])
    return system.open_input_stream(inner)


def _long_cells(head: bytes, charset: str, sep: str) -> list[int]:
    """Columns that hold a value over LONGEST_LOOKUP in the head. A guess that saves a second plan."""
    text = head.decode("cp1252" if charset == "windows-1252" else charset, errors="replace")
    found = (header_cells(line, sep) for line in text.splitlines()[1:-1] if len(line) > LONGEST_LOOKUP)
    return sorted({i for line in found for i, cell in enumerate(line) if len(cell) > LONGEST_LOOKUP})


def _look(read: Callable[[int], bytes], charset: str | None = None) -> tuple:
    """Charset, ``head_facts`` and long columns of a file, reading on until its header is complete."""
    head = read(HEAD_BYTES)
    if not head:
        return "UTF-8", ",", None, False, "empty file", []
    charset, complete = charset or charset_of(head), len(head) < HEAD_BYTES
    facts = head_facts(head, complete, charset)
    while facts is None:
        more = read(len(head))
        head += more
        if more and len(head) > LONGEST_HEAD:
            return charset, ",", None, False, "the header is longer than 64 MiB", []
        facts = head_facts(head, not more, charset)
    return charset, *facts, _long_cells(head, charset, facts[0] or ",")


UNREACHED = "not reached"


def _head_reader(charset: str | None):
    def read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size"]):
                try:
                    with _open(unquote(path)) as stream:
                        rows.append((path, size, *_look(stream.read, charset)))
                except (OSError, ValueError, NotImplementedError):  # no Python access to this file system
                    rows.append((path, size, None, None, None, None, UNREACHED, []))
            yield pd.DataFrame(rows, columns=["path", "size", "charset", "sep", "header", "open", "problem", "long"])

    return read_heads


def _look_through_hadoop(spark: SparkSession, path: str, charset: str | None = None) -> tuple:
    """``_look`` by the driver, for file systems that only Hadoop knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(unquote(path))
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    io = jvm.org.apache.commons.io
    try:
        return _look(lambda n: bytes(io.IOUtils.toByteArray(io.input.BoundedInputStream(stream, n))), charset)
    finally:
        stream.close()


def files_under(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of a path, a folder or a glob that are not empty: ``path, size``.
    Reads no content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))


def sniff_files(spark: SparkSession, path: str | list[str], charset: str | None = None) -> DataFrame:
    """One row per file: ``path, size, charset, sep, header, open, problem, long``.
    ``sep`` is null for a file of one line, ``open`` tells that the head has a quoted
    newline, ``problem`` why there is no header, ``long`` which columns hold long values. ``charset`` settles what the
    head would only guess."""
    return files_under(spark, path).mapInPandas(_head_reader(charset), SCHEMA)


def literal_path(path: str) -> str:
    """A path as Spark names it, safe from being read as a glob."""
    return "".join("\\" + ch if ch in "\\[]{}*?" else ch for ch in unquote(path))


def charset_votes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The charset of files without a byte-order mark, from all their lines.

    Windows-1252 if more lines are broken as UTF-8 than hold whole UTF-8 characters
    beyond ASCII, else UTF-8. So a stray byte, wherever it lies, is one U+FFFD, and a
    file in the other charset is read as such, wherever its first such line lies.
    """
    raw = spark.read.text([literal_path(p) for p in paths])
    valid, wide = F.is_valid_utf8("value"), F.octet_length("value") != F.length("value")
    counts = raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count_if(~valid).alias("bad"), F.count_if(valid & wide).alias("good"))
    return {r["path"]: "windows-1252" if r["bad"] > r["good"] else "UTF-8" for r in counts.collect()}  # one short row per file


@dataclass(frozen=True)
class FileGroup:
    """Files that are read alike: same charset, separator and header text."""

    charset: str
    sep: str
    header: str
    labels: tuple[str, ...]
    files: tuple[tuple[str, int], ...]  # (path, row number base)
    quoted_newlines: bool
    root: str | list[str] | None = None  # what to read instead of naming every file
    settled: bool = False  # whether the charset rests on more than the head
    long_labels: frozenset[str] = frozenset()  # labels with long values in a head


# Row numbers a file can take beyond its size: positions within a scan partition.
_SLACK = 1 << 33


def _heads(spark: SparkSession, path: str | list[str], charset: str | None) -> dict[str, tuple]:
    found = {}
    for name, size, *facts in sniff_files(spark, path, charset).collect():
        found[name] = (size, *(_look_through_hadoop(spark, name, charset) if facts[4] == UNREACHED else facts))
    return found


def file_groups(
    spark: SparkSession,
    path: str | list[str],
    charset: str | None = None,
    sep: str | None = None,
    known: dict[str, str] | None = None,
) -> list[FileGroup]:
    """Groups of the files to load, in path order of their first file.

    ``charset`` and ``sep`` hold for all files if given; ``known`` has the charsets of
    files that ``charset_votes`` has settled. Files that don't look like UTF-8 at
    their head are settled here. A file that is a header alone takes the separator of the
    files with the same header. The driver holds one short row per file, as Spark's
    own file listing does.
    """
    rows, known = _heads(spark, path, charset), dict(known or {})
    if not rows:
        raise LoadRejected(f"no file at {path}")
    if charset is None:
        doubtful = [p for p, r in rows.items() if r[1] == "windows-1252" and p not in known]
        if doubtful:
            known |= charset_votes(spark, doubtful)
        for name in ("UTF-8", "windows-1252"):
            other = [p for p, c in known.items() if c == name and p in rows and rows[p][1] in ("UTF-8", "windows-1252") and rows[p][1] != name]
            if other:
                rows |= _heads(spark, [literal_path(p) for p in other], name)
    told = {header: found_sep for _, _, found_sep, header, *_ in rows.values() if found_sep}
    groups: dict[tuple, dict] = {}
    base = 0
    for name in sorted(rows):
        size, code, found_sep, header, is_open, problem, long = rows[name]
        if problem:
            raise LoadRejected(f"{problem}: {name}")
        group = groups.setdefault((code, sep or found_sep or told.get(header, ","), header, charset is not None or name in known), {"files": [], "open": False, "long": set()})
        group["files"].append((name, base))
        group["open"] |= is_open
        group["long"] |= set(long)
        base += size + _SLACK
    out = []
    for (code, found_sep, header, settled), group in groups.items():
        labels = tuple(normal_labels(header_cells(header, found_sep)))
        if "__rownr" in labels:
            raise LoadRejected("a column may not be called __rownr")
        root = path if len(groups) == 1 and len(rows) > 1 else None
        long = frozenset(labels[i] for i in group["long"] if i < len(labels))
        out.append(FileGroup(code, found_sep, header, labels, tuple(group["files"]), group["open"], root, settled, long))
    if any(set(g.labels) != set(out[0].labels) for g in out):
        raise LoadRejected("the files do not have the same columns")
    return out
