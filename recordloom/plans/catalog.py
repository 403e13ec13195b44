"""The catalogue on disk: append-only logs, one small JSON file per entry.

Every change adds a file, so parallel loads never share an output path, and a
reader sees an entry as a whole or not at all. Tables are views over the logs,
which grow with the number of changes, not with the data. One driver at a time
changes a catalogue.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordloom import errors
from recordloom.functions.ids import UUID_SHAPE
from recordloom.operators import registry
from recordloom.sources.sniff import LONGEST_LOOKUP
from recordloom.sources.records import record_schema

LOGS = {
    "datasets": "id string, created timestamp, data_table string, dropped boolean, seq long",
    "status": "dataset_id string, seq long, status int",
    "aliases": "dataset_id string, seq long, aliases array<string>",
    "loads": "dataset_id string, seq long, mode string, path string, labels array<string>, "
    "n_rows long, next_rownr long, long_values array<int>, source string, fingerprint string",
}


_LOAD_FIELDS = ("mode", "path", "labels", "n_rows", "next_rownr", "long_values", "source", "fingerprint")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._lock = threading.RLock()
        self._last = 0

    # -- log files ---------------------------------------------------------

    def _filesystem(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._filesystem(path)
        return fs.exists(where)

    def _next(self) -> int:
        with self._lock:
            self._last = max(time.time_ns(), self._last + 1)
            return self._last

    def _append(self, log: str, rows: list[tuple]) -> None:
        """Add one entry of one or more rows of a dataset, whose id comes first in each;
        it appears in the dataset's folder when its file is renamed."""
        fields = T.StructType.fromDDL(LOGS[log]).fieldNames()
        text = "".join(json.dumps(dict(zip(fields, row))) + "\n" for row in rows)
        name = uuid.uuid4().hex
        folder = f"{self.root}/{log}/{rows[0][0]}"
        fs, hidden = self._filesystem(f"{folder}/_{name}")
        stream = fs.create(hidden)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if not fs.rename(hidden, self._filesystem(f"{folder}/{name}.json")[1]):
            raise OSError(f"the entry {name} of {log} could not be published")

    def log(self, name: str, dataset_id: str | None = None) -> DataFrame:
        """The entries of one dataset, which are all that is then read, or of all."""
        folder = f"{self.root}/{name}" + (f"/{dataset_id}" if dataset_id else "")
        if not self._exists(folder):
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).option("recursiveFileLookup", "true").json(folder)

    # -- tables ------------------------------------------------------------

    def datasets(self, dataset_id: str | None = None) -> DataFrame:
        """``id, status, created, data_table`` of one or all datasets not dropped."""
        entry = F.max_by(F.struct("created", "data_table", "dropped"), "seq").alias("d")
        live = self.log("datasets", dataset_id).groupBy("id").agg(entry).where("NOT d.dropped")
        status = registry.current_status(self.log("status", dataset_id))
        joined = live.join(status, live["id"] == status["dataset_id"], "left")
        return joined.select("id", F.col("status"), F.col("d.created").alias("created"), F.col("d.data_table").alias("data_table"))

    def aliases(self, dataset_id: str | None = None) -> DataFrame:
        latest = self.log("aliases", dataset_id).groupBy("dataset_id").agg(F.max_by("aliases", "seq").alias("a"))
        return latest.select("dataset_id", F.explode("a").alias("alias"))

    # -- datasets ----------------------------------------------------------

    def create(self) -> str:
        """A new empty dataset; its id."""
        with self._lock:
            dataset_id = str(uuid.uuid4())
            while self._exists(f"{self.root}/datasets/{dataset_id}"):
                dataset_id = str(uuid.uuid4())
            table = "data_" + dataset_id.replace("-", "")
            now = dt.datetime.now(dt.timezone.utc).isoformat()
            self._append("datasets", [(dataset_id, now, table, False, self._next())])
            self.set_status(dataset_id, registry.CREATED)
            return dataset_id

    def set_status(self, dataset_id: str, status: int) -> None:
        self._append("status", [(dataset_id, self._next(), status)])

    def status(self, dataset_id: str) -> int:
        row = registry.current_status(self.log("status", dataset_id)).first() if self._is_id(dataset_id) else None
        if row is None:
            raise errors.NotFound(dataset_id)
        return row["status"]

    def settle_interrupted(self) -> None:
        """After a restart: loads that never ended become errors."""
        halted = registry.current_status(self.log("status")).where(F.col("status") == registry.PROCESSING)
        for row in halted.toLocalIterator():
            self.set_status(row["dataset_id"], registry.ERROR)

    @staticmethod
    def _is_id(name: str) -> bool:
        return re.match(UUID_SHAPE.replace(r"\z", r"\Z"), name) is not None

    def exists(self, dataset_id: str) -> bool:
        return self._is_id(dataset_id) and not self.datasets(dataset_id).isEmpty()

    def resolve(self, name: str) -> str:
        """Dataset id behind an alias or an id. An id, which no alias can look like, is looked up alone."""
        if self._is_id(name):
            if not self.exists(name):
                raise errors.NotFound(name)
            return name
        names = self.spark.createDataFrame([(name,)], "name string")
        row = registry.resolve_names(names, self.aliases(), self.datasets()).first()
        if row is None or row["dataset_id"] is None:
            raise errors.NotFound(name)
        return row["dataset_id"]

    def drop(self, dataset_id: str) -> None:
        """Remove a settled dataset with its aliases and files."""
        with self._lock:
            row = self.datasets(dataset_id).first() if self._is_id(dataset_id) else None
            if row is None:
                raise errors.NotFound(dataset_id)
            if row["status"] not in (registry.AVAILABLE, registry.ERROR):
                raise errors.Locked(dataset_id)
            self._append("datasets", [(dataset_id, None, row["data_table"], True, self._next())])
            self._append("aliases", [(dataset_id, self._next(), [])])
            self.remove(self.data_folder(row["data_table"]))

    # -- aliases -----------------------------------------------------------

    def aliases_of(self, dataset_id: str) -> list[str]:
        return sorted(r["alias"] for r in registry.aliases_of(self.aliases(dataset_id), dataset_id).collect())

    def _change_aliases(self, dataset_id: str, wanted: list[str], change) -> bool:
        with self._lock:
            asked = [(dataset_id, a) for a in wanted] or [(dataset_id, None)]
            requested = self.spark.createDataFrame(asked, "dataset_id string, alias string")
            table = change(requested, self.aliases(), self.datasets())
            got = sorted(r["alias"] for r in registry.aliases_of(table, dataset_id).collect())
            if not set(wanted) <= set(got) or (not wanted and got):
                return False
            self._append("aliases", [(dataset_id, self._next(), got)])
            return True

    def set_aliases(self, dataset_id: str, wanted: list[str]) -> bool:
        """Replace the aliases, all or nothing; False if one is not acceptable."""
        return self._change_aliases(dataset_id, wanted, registry.replace_aliases)

    def add_aliases(self, dataset_id: str, wanted: list[str]) -> bool:
        return self._change_aliases(dataset_id, wanted, registry.add_aliases) if wanted else True

    # -- stored records ----------------------------------------------------

    def data_folder(self, data_table: str) -> str:
        return f"{self.root}/data/{data_table}"

    def remove(self, path: str) -> None:
        fs, where = self._filesystem(path)
        fs.delete(where, True)

    def _loads(self, dataset_id: str) -> list:
        return self.log("loads", dataset_id).orderBy("seq").collect()

    def remove_replaced(self, dataset_id: str) -> None:
        """Delete the files of earlier versions; queries planned on them will fail."""
        current = {s["path"] for s in self.segments(dataset_id)}
        for load in self._loads(dataset_id):
            if load["path"] not in current:
                self.remove(load["path"])
                self.remove(load["path"] + ".side")

    def segments(self, dataset_id: str) -> list:
        """Published loads that make up the current version, oldest first."""
        rows = self._loads(dataset_id)
        starts = [i for i, r in enumerate(rows) if r["mode"] == "replace"]
        return rows[starts[-1] :] if starts else rows

    def publish(self, dataset_id: str, loads: list[dict]) -> None:
        """Make written segments part of the dataset, all with one log entry."""
        rows = [(dataset_id, self._next(), *[load.get(f) for f in _LOAD_FIELDS]) for load in loads]
        self._append("loads", rows)

    def loaded_from(self, source: str, dataset_id: str | None = None) -> bool:
        return not self.log("loads", dataset_id).where(F.col("source") == source).isEmpty()

    def records(self, dataset_id: str) -> DataFrame:
        """The stored records; raises for a dataset that was never loaded."""
        if self.status(dataset_id) == registry.CREATED:
            raise errors.NotReady(dataset_id)
        segments = self.segments(dataset_id)
        if not segments:
            return self.spark.createDataFrame([], record_schema([]))
        schema = record_schema(list(segments[0]["labels"]))
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in segments])

    def lookup_columns(self, dataset_id: str) -> list[str]:
        """Columns whose stored values are all short enough for a lookup layout. Loads
        note the longest value of lines over that length; shorter lines cannot matter."""
        most: dict[str, int] = {}
        for s in self.segments(dataset_id):
            for label, n in zip(s["labels"], s["long_values"]):
                most[label] = max(most.get(label, 0), n or 0)
        return [label for label, n in most.items() if n <= LONGEST_LOOKUP]

    def info(self, name: str, base_url: str = "", context: str | None = None) -> DataFrame:
        from recordloom.operators.profile import dataset_info

        dataset_id = self.resolve(name)
        status = self.status(dataset_id)
        empty = self.spark.createDataFrame([], record_schema([]))
        records = empty if status == registry.CREATED else self.records(dataset_id)
        return dataset_info(records, self.datasets(dataset_id), self.aliases(dataset_id), dataset_id, base_url, context)

    def export(self, name: str, path: str, form: str = "csv", **options) -> None:
        """Write all records of a dataset, named by id or alias, as "csv" or "json" lines
        (``plans.export`` has the options). Raises for a dataset that was never loaded."""
        from recordloom.plans.export import write_csv, write_json_lines

        if form not in ("csv", "json"):
            raise ValueError("form must be csv or json")
        (write_csv if form == "csv" else write_json_lines)(self.records(self.resolve(name)), path, **options)

    def query(self, name: str, request: dict[str, str] | None = None, mode: str = "full", max_limit: int = 100) -> DataFrame:
        """A page of a dataset for a raw request, reserved keys included."""
        from recordloom.operators.paging import query_request

        return query_request(self.records(self.resolve(name)), request or {}, mode, max_limit)
