"""Token ids in files: one id array per file, with Elias-Fano coded document ends.

A file is: magic, ids (16 bits each where the vocabulary allows it, else 32), the
coded document ends, the coded doc_ids less the smallest, and a fixed-size footer
with the sizes, the smallest doc_id, the number of null doc_ids (they come first) and
a CRC of the ids. ``IdFile`` finds any document by ``select`` without reading more
than its ids.

Files are written by tasks over a range partitioning by doc_id, each under a name of
its own; the manifest, a table that Spark commits, lists those of the tasks that
ended well. So a task that is run again leaves at most a file that nobody reads.

Defined cases: a null text is a document with the end id alone; null doc_ids come
first; repeated rows are documents of their own; an empty table gives an empty
manifest; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recordloom.llm.common import saved, text_or_empty
from recordloom.llm.elias_fano import EliasFano
from recordloom.llm.word_ids import word_ids
from recordloom.session import fresh_folder

MAGIC = b"EFIDS\x00\x01\n"
FOOTER = "<QQQQqQIB3x"  # documents, ids, bytes of ends, bytes of doc_ids, smallest doc_id, null doc_ids, CRC, bytes per id
TOKENS_PER_FILE = 64 * 2**20
PIECE = 2**22
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def _file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return LocalFileSystem(), parsed.path
    return FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Hadoop gives it, so that every task means the same place by it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


class _Writer:
    """One file being written; ids go out as they come, the boundaries are held."""

    def __init__(self, folder: str, width: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.ids"
        fs, local = _file_system(self.path)
        fs.create_dir(local.rsplit("/", 1)[0])
        self.out = fs.open_output_stream(local)
        self.out.write(MAGIC)
        self.width, self.crc, self.ends, self.doc_ids, self.nulls, self.n = width, 0, [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.n += len(ids)
        self.ends.append(self.n)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self, part: int, seq: int) -> dict:
        low = self.doc_ids[0] if self.doc_ids else 0
        ends = EliasFano.encode(np.array(self.ends, dtype=np.uint64)).to_bytes()
        names = EliasFano.encode(np.array([d - low for d in self.doc_ids], dtype=np.uint64)).to_bytes()
        self.out.write(ends + names + struct.pack(FOOTER, len(self.ends), self.n, len(ends), len(names), low, self.nulls, self.crc, self.width))
        self.out.close()
        return {"part": part, "seq": seq, "path": self.path, "n_docs": len(self.ends), "n_ids": self.n}


class IdFile:
    """Reads one file; only the boundaries are held in memory."""

    def __init__(self, path: str):
        fs, local = _file_system(path)
        self.file = fs.open_input_file(local)
        size = struct.calcsize(FOOTER)
        end = self.file.size() - size
        self.n_docs, self.n_ids, ends, names, self.low, self.nulls, self.crc, self.width = struct.unpack(FOOTER, self.file.read_at(size, end))
        self.ends = EliasFano.from_bytes(self.file.read_at(ends, end - ends - names))
        self.names = EliasFano.from_bytes(self.file.read_at(names, end - names))

    def _ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.width, len(MAGIC) + first * self.width), f"<u{self.width}").astype("<u4")

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """The i-th document: its doc_id and ids."""
        return (None if i < self.nulls else self.low + self.names.select(i - self.nulls)), self._ids(*self.bounds(i))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order: doc_id, start in the file, ids. Boundaries and names come from ``select`` one by
        one; ids are read in pieces of bounded size, or a document's if it is longer. Checks the CRC."""
        start = held_from = crc = 0
        ids = np.empty(0, "<u4")
        for i in range(self.n_docs):
            end = self.ends.select(i)
            if end > held_from + len(ids):
                ids, held_from = self._ids(start, min(self.n_ids, max(end, start + PIECE))), start
            mine = ids[start - held_from : end - held_from]
            crc = zlib.crc32(mine.astype(f"<u{self.width}").tobytes(), crc)
            yield (None if i < self.nulls else self.low + self.names.select(i - self.nulls)), start, mine
            start = end
        if crc != self.crc:
            raise ValueError("the ids of a file don't agree with its CRC")


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str, tokens_per_file: int = TOKENS_PER_FILE, partitions: int | None = None) -> DataFrame:
    """Writes all documents in ascending doc_id order; gives the manifest: part, seq, path, n_docs, n_ids, start."""
    folder = qualified(docs.sparkSession, folder)

    def write(batches):
        encoder, part, seq, writer = word_ids(tokenizer), TaskContext.get().partitionId(), 0, None
        width = 2 if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 2**16 else 4
        done = []
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                writer = writer or _Writer(folder, width)
                writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                if writer.n >= tokens_per_file:
                    done.append(writer.close(part, seq))
                    writer, seq = None, seq + 1
        if writer:
            done.append(writer.close(part, seq))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ranged = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    manifest = saved(ranged.sortWithinPartitions("doc_id").mapInArrow(write, MANIFEST), "id-files")
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))  # one short row per file


def read_ids(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), and the ids if wanted."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if keep_ids else []))

    def read(batches):
        for batch in batches:
            for path, offset in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                rows, held = [], 0
                for doc_id, start, ids in IdFile(path).documents():
                    row = (doc_id, offset + start, len(ids), zlib.crc32(ids.tobytes()))
                    rows.append(row + (ids.astype(np.int64),) if keep_ids else row)
                    held += 1 + (len(ids) if keep_ids else 0)
                    if held >= 2**18:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return manifest.select("path", "start").repartition(max(1, min(10_000, manifest.count()))).mapInArrow(read, out)


def written_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the documents' ids in the shared folder and reads the files back."""
    return read_ids(saved(write_ids(docs, tokenizer, end_id, fresh_folder(spark, "token-ids")), "id-manifest"))
