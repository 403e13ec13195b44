"""A content-addressed archive of web records, and WARC files from and to it.

Payload bytes are stored once, under their SHA-256 digest; the header of every record
is stored apart, byte for byte, with the digest of its payload. Original records come
back through one join. A digest is taken at its word only if checked: when payloads are
stored, all that share a SHA-256 digest must share length and SHA-1 digest, and whenever
they are read, each stored payload is digested again.

Of records with equal payloads of at least ``least`` bytes the first one, by page_id, is a
``response`` with the payload as its block; the others ``revisit`` it and have no block.

Payloads are grouped by digest with map-side combining, so a payload that a third of all
records share travels once per task. The join back is one between two written tables,
whose hot keys adaptive execution splits.

Defined cases: a null payload is empty; repeated rows are records of their own, of which
one at most is a response with that payload; a null page_id comes last; line breaks and other
controls in an address are percent-encoded; a null address leaves the field out; an empty
table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.session import fresh_folder

# The WARC format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE, BLANK, RECORD_END = "\r\n", "\r\n\r\n", "\r\n\r\n"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # as conv() writes numbers of base 32

HEADERS = "record long, page_id long, sha256 binary, header binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base-32 characters: five hexadecimal digits make four of them."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _urn(record: Column) -> Column:
    name = F.md5(F.concat(F.lit("record "), record.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _address(url: Column) -> Column:
    """An address that cannot break a header: controls and blanks are percent-encoded."""
    clean = url.cast("string")
    for code in [*range(0x21), 0x7F]:
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), clean).otherwise(url.cast("string"))


def _order() -> list[Column]:
    return [F.col("page_id").isNull(), F.col("page_id"), F.col("record")]


def _first(a: str) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(_order(), ("none", "page_id", "record"))]).alias(a)


def store_pages(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives page_id, url and html: one WARC record per row, payload the html in UTF-8.

    ``folder`` gets three tables: ``rows`` (a number, page_id, address and digests of each
    page), ``payloads`` (sha256, payload, bytes, sha1, holder) and ``headers`` (HEADERS).
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    told = source.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", digest.alias("sha256"), F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    told.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")

    same = F.struct("bytes", "sha1")
    groups = rows.groupBy("sha256").agg(F.min(_first("f")).alias("f"), F.min(same).alias("low"), F.max(same).alias("high"))
    proper = F.assert_true(F.col("low") == F.col("high"), F.lit("different payloads share a SHA-256 digest"))
    groups = groups.select("sha256", F.col("low.bytes").alias("bytes"), F.col("low.sha1").alias("sha1"), F.struct(F.col("f.record").alias("record"), F.col("f.page_id").alias("page_id")).alias("holder"), proper.alias("checked"))
    contents = source.select(digest.alias("sha256"), "payload").groupBy("sha256").agg(F.min("payload").alias("payload"))
    stored = contents.join(groups.filter("checked is null").drop("checked"), "sha256")
    stored.write.parquet(f"{folder}/payloads")

    known = spark.read.parquet(f"{folder}/payloads").select("sha256", "holder")
    placed = rows.join(known, "sha256")
    revisit = (F.col("bytes") >= least) & (F.col("record") != F.col("holder.record"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    common = [F.lit(VERSION), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), field("WARC-Record-ID", _urn(F.col("record"))), F.lit(f"WARC-Date: {date}")]
    refers = [F.when(revisit, F.lit(f"WARC-Profile: {IDENTICAL}")), F.when(revisit, field("WARC-Refers-To", _urn(F.col("holder.record"))))]
    size = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    rest = [field("WARC-Target-URI", _address(F.col("url"))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.lit("Content-Type: text/html"), field("Content-Length", size), field("X-Page-Id", F.col("page_id"))]
    header = F.concat(F.concat_ws(LINE, *common, *refers, *rest), F.lit(BLANK))  # concat_ws leaves out what is null
    placed.select("record", "page_id", "sha256", header.cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def header_field(name: str) -> Column:
    """A field of ``header`` as text; null where it is absent."""
    text = F.col("header").cast("string")
    found = F.regexp_extract(text, rf"(?i)\r\n{re.escape(name)}:[ \t]*+([^\r\n]*)", 1)
    return F.when(text.rlike(rf"(?i)\r\n{re.escape(name)}:"), found)


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as it was archived: record, page_id, header, payload (of a revisit: that of the record
    it refers to) and holder (record, page_id) of the payload. Stored payloads are digested again."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads")
    proper = F.assert_true(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.lit("a stored payload is not what its digest says"))
    payloads = payloads.select("sha256", "payload", "holder", proper.alias("checked")).filter("checked is null").drop("checked")
    return headers.join(payloads, "sha256").select("record", "page_id", "header", "payload", "holder")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived page, from its record: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    rows = originals(spark, folder)
    kind = header_field("WARC-Type")
    told = header_field("WARC-Payload-Digest")
    digest = base32_sha1(F.col("payload"))
    proper = F.assert_true(told == F.concat(F.lit("sha1:"), digest), F.lit("a payload is not what its record says"))
    return rows.select(
        header_field("X-Page-Id").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(proper.isNull(), digest).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", F.col("holder.page_id")).alias("refers_to"),
        header_field("WARC-Target-URI").alias("url"),
    )


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives pages in the shared folder and reads them back, see ``read_pages``."""
    folder = fresh_folder(pages.sparkSession, "archive")
    store_pages(pages, folder, least)
    return read_pages(pages.sparkSession, folder)


# -- WARC files -------------------------------------------------------------------


def write_warc(spark: SparkSession, folder: str, path: str, compression: str = "none") -> None:
    """The archive as WARC files, a revisit without its payload. A file holds the records of one task."""
    block = F.when(header_field("WARC-Type") != "revisit", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), block).cast("string")  # bytes pass as they are
    originals(spark, folder).select(record).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of an uncompressed WARC file; the header ends with its blank line."""
    at = 0
    while at < len(data):
        end = data.find(BLANK.encode(), at)
        size = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", data[at : end + 2], re.IGNORECASE) if end >= 0 else None
        if size is None or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        start = end + len(BLANK)
        stop = start + int(size[1])
        if data[stop : stop + 4] != RECORD_END.encode():
            raise ValueError(f"the record at byte {at} does not end where its header says")
        yield data[at:start], data[start:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: path, header, payload. A file is one task's work and one value (2 GB)."""

    def split(batches):
        import zlib

        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    parts = []
                    while data:
                        member = zlib.decompressobj(31)
                        parts.append(member.decompress(data) + member.flush())
                        data = member.unused_data
                    data = b"".join(parts)
                for header, block in split_records(data):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([header], pa.binary()), pa.array([block], pa.binary())], ["path", "header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "path string, header binary, payload binary")


def store_records(records: DataFrame, folder: str) -> None:
    """Archives records of any kind, as ``read_warc`` gives them: headers byte for byte, each payload once.
    Records are numbered in no particular order; ``originals`` gives them back."""
    spark = records.sparkSession
    digest = F.unhex(F.sha2("payload", 256))
    numbered = records.select(F.monotonically_increasing_id().alias("record"), F.lit(None).cast("long").alias("page_id"), digest.alias("sha256"), "header")
    numbered.write.parquet(f"{folder}/headers")
    firsts = spark.read.parquet(f"{folder}/headers").groupBy("sha256").agg(F.min("record").alias("record"))
    contents = records.select(digest.alias("sha256"), "payload").groupBy("sha256").agg(F.min("payload").alias("payload"))
    holder = F.struct("record", F.lit(None).cast("long").alias("page_id")).alias("holder")
    joined = contents.join(firsts.select("sha256", holder), "sha256")
    joined.select("sha256", "payload", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"), "holder").write.parquet(f"{folder}/payloads")
