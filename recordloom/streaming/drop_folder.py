"""Loading files as they arrive in a folder, one sub-folder per dataset."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.errors import NotFound
from recordloom.operators import registry
from recordloom.plans.catalog import Catalog
from recordloom.plans.load import load_csv


REFUSED = "folder string, path string"


def dataset_named(catalog: Catalog, name: str) -> str | None:
    """Dataset with this alias, created if there is none; None if the name cannot be an alias."""
    try:
        return catalog.resolve(name)
    except NotFound:
        if not (name and all(c.isalpha() or c.isdecimal() for c in name)):  # letters and digits of any script
            return None
        dataset_id = catalog.create()
        if not catalog.set_aliases(dataset_id, [name]):
            raise ValueError(f"{name!r} has become the name of another dataset") from None
        return dataset_id


def _as_is(path: str) -> str:
    """A path that is not read as a glob."""
    return "".join("\\" + ch if ch in "\\[]{}*?" else ch for ch in path)


def ingest_batch(catalog: Catalog, files: DataFrame, batch: str, loads_at_once: int = 5, refused_at: str | None = None) -> None:
    """Load the files of one micro-batch (``path``), those of a dataset as one load.

    So the jobs and log entries of a batch follow its datasets, not its files. If
    that load is rejected, the files are loaded one by one in path order, and a broken
    one harms only itself. Different datasets load at the same time. A batch that
    runs again after a failure skips what it has already published. Files of a folder
    whose name cannot be an alias are not loaded and don't hold up the others;
    ``refused_at`` gets a table of them.
    """
    per_dataset: dict[str, list[str]] = defaultdict(list)
    for row in files.select("path").collect():  # at most maxFilesPerTrigger short rows
        per_dataset[unquote(row["path"].rsplit("/", 2)[-2])].append(row["path"])

    def run(name: str) -> list[tuple[str, str]]:
        dataset_id = dataset_named(catalog, name)
        if dataset_id is None:
            return [(name, path) for path in per_dataset[name]]
        done = {r["source"] for r in catalog.log("loads", dataset_id).where(F.col("source").startswith(f"{batch}:")).select("source").collect()}
        whole = f"{batch}:*"
        if whole in done:
            return []
        catalog.set_status(dataset_id, registry.ACCEPTED)
        paths = [p for p in sorted(per_dataset[name]) if f"{batch}:{p}" not in done]
        together = [_as_is(p) for p in paths]
        if len(paths) > 1 and not done and load_csv(catalog, dataset_id, together, "append", source=whole) == registry.AVAILABLE:
            return []
        for path in paths:
            load_csv(catalog, dataset_id, _as_is(path), "append", source=f"{batch}:{path}")
        return []

    with ThreadPoolExecutor(max_workers=loads_at_once) as pool:
        bad = [row for rows in pool.map(run, sorted(per_dataset)) for row in rows]
    if bad and refused_at:
        catalog.spark.createDataFrame(bad, REFUSED).coalesce(1).write.mode("overwrite").parquet(refused_at)


def refused(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Files that ``watch_folder`` with this checkpoint has not loaded, as their folder's name cannot be an alias."""
    return spark.read.schema(REFUSED).option("recursiveFileLookup", "true").parquet(f"{checkpoint}-refused")


def watch_folder(
    spark: SparkSession,
    catalog: Catalog,
    folder: str,
    checkpoint: str,
    loads_at_once: int = 5,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Start loading what is in ``folder/<dataset>/`` and stop when all is read.
    Call again, or on a schedule, with the same checkpoint to go on."""
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(F.col("path"))
    )

    def batch(files: DataFrame, number: int) -> None:
        ingest_batch(catalog, files, f"{checkpoint}#{number}", loads_at_once, f"{checkpoint}-refused/batch-{number}")

    return (
        arrivals.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
