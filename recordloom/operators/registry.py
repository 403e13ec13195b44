"""Catalogue questions as joins and aggregates.

Tables: ``datasets(id, status, created, data_table)``, ``aliases(dataset_id,
alias)``, ``status_log(dataset_id, seq, status)``. Join sides carry no hints:
Spark broadcasts a side only when its size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.ids import is_uuid
from recordloom.functions.text import is_alphanumeric

# Status codes of a dataset.
CREATED, ACCEPTED, PROCESSING, AVAILABLE, ERROR = range(5)
STATUS_NAMES = {0: "Created", 1: "Accepted data", 2: "Processing", 3: "Available", 4: "Error"}


def status_name(code: Column) -> Column:
    out = F.lit("Unknown")
    for number, name in STATUS_NAMES.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def current_status(status_log: DataFrame) -> DataFrame:
    """Latest status per dataset."""
    return status_log.groupBy("dataset_id").agg(F.max_by("status", "seq").alias("status"))


def settle_interrupted(status_log: DataFrame) -> DataFrame:
    """Latest status per dataset after a restart: what was processing is an error."""
    halted = F.when(F.col("status") == PROCESSING, F.lit(ERROR)).otherwise(F.col("status"))
    return current_status(status_log).select("dataset_id", halted.cast("int").alias("status"))


def resolve_names(names: DataFrame, aliases: DataFrame, datasets: DataFrame, name: str = "name") -> DataFrame:
    """Each name with the dataset it means: an alias first, else a UUID.

    ``valid`` is false for names that are neither; ``dataset_id`` is null where
    no dataset exists.
    """
    known = aliases.select(F.col("alias").alias("__alias"), F.col("dataset_id").alias("target"))
    ids = datasets.select(F.col("id").alias("dataset_id"), *[c for c in datasets.columns if c != "id"])
    keyed = names.withColumn("__name", _spread(F.col(name)))
    looked_up = keyed.join(known, F.col("__name") == F.col("__alias"), "left")
    wanted = F.coalesce(F.col("target"), F.when(is_uuid(F.col(name)), F.col(name)))
    typed = looked_up.select(*[keyed[c] for c in names.columns], wanted.alias("wanted")).withColumn("__wanted", _spread(F.col("wanted")))
    joined = typed.join(ids, F.col("__wanted") == F.col("dataset_id"), "left")
    return joined.withColumn("valid", F.col("wanted").isNotNull()).drop("wanted", "__wanted")


def _spread(key: Column) -> Column:
    """A join key in which rows without one, which match nothing, do not meet in one partition. No alias and no id
    holds U+0000."""
    nothing = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    return F.when(key.isNotNull(), key).otherwise(nothing)


def available_aliases(candidates: DataFrame, aliases: DataFrame, datasets: DataFrame, name: str = "alias") -> DataFrame:
    """Candidates that are neither a dataset id nor an alias already."""
    taken = aliases.select(F.col("alias").alias("__taken"))
    ids = datasets.select(F.col("id").alias("__id"))
    free = candidates.join(ids, F.col(name) == F.col("__id"), "left_anti")
    return free.join(taken, F.col(name) == F.col("__taken"), "left_anti")


def replace_aliases(requested: DataFrame, aliases: DataFrame, datasets: DataFrame) -> DataFrame:
    """Alias table after every dataset named in ``requested`` asks for a new set.

    ``requested(dataset_id, alias)``; a null alias alone asks for none. A
    dataset's request is taken as a whole or not at all: each alias must be its
    own already, or well formed, free, and asked for by nobody else.
    """
    asked = requested.select("dataset_id", "alias").distinct()
    owner = aliases.select(F.col("alias").alias("__alias"), F.col("dataset_id").alias("__owner"))
    ids = datasets.select(F.col("id").alias("__id"))
    rivals = asked.groupBy("alias").agg(F.count("*").alias("__askers"))
    checked = (
        asked.join(owner, F.col("alias") == F.col("__alias"), "left")
        .join(ids, F.col("alias") == F.col("__id"), "left")
        .join(rivals.withColumnRenamed("alias", "__asked"), F.col("alias") == F.col("__asked"), "left")
    )
    own = F.col("__owner") == F.col("dataset_id")
    free = is_alphanumeric(F.col("alias")) & F.col("__owner").isNull() & F.col("__id").isNull() & (F.col("__askers") == 1)
    good = F.col("alias").isNull() | F.coalesce(own, F.lit(False)) | F.coalesce(free, F.lit(False))
    verdict = checked.groupBy("dataset_id").agg(F.min(good).alias("accepted"))
    accepted = verdict.where("accepted").select("dataset_id")
    kept = aliases.join(accepted, "dataset_id", "left_anti").select("dataset_id", "alias")
    new = asked.where(F.col("alias").isNotNull()).join(accepted, "dataset_id", "left_semi")
    return kept.unionByName(new)


def add_aliases(requested: DataFrame, aliases: DataFrame, datasets: DataFrame) -> DataFrame:
    """The same with the present aliases of each dataset added to its request."""
    named = requested.select("dataset_id").distinct()
    present = aliases.join(named, "dataset_id", "left_semi").select("dataset_id", "alias")
    return replace_aliases(requested.select("dataset_id", "alias").unionByName(present), aliases, datasets)


def aliases_of(aliases: DataFrame, dataset_id: str) -> DataFrame:
    return aliases.where(F.col("dataset_id") == dataset_id).select("alias")


def dataset_ids(datasets: DataFrame) -> DataFrame:
    return datasets.select("id")


def dataset_count(datasets: DataFrame) -> DataFrame:
    return datasets.agg(F.count("*").alias("amount"))


def existing(names: DataFrame, datasets: DataFrame, name: str = "name") -> DataFrame:
    """Names that are ids of datasets; anything but a UUID is none."""
    ids = datasets.select(F.col("id").alias("__id"))
    return names.where(is_uuid(F.col(name))).join(ids, F.col(name) == F.col("__id"), "left_semi")


def service_counters(datasets: DataFrame, version: str) -> DataFrame:
    return datasets.agg(
        F.count("*").alias("datasets"),
        F.count_if(F.col("status") == PROCESSING).alias("active_loads"),
    ).withColumn("version", F.lit(version))


def drop_datasets(names: DataFrame, datasets: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the named datasets; only settled ones can go."""
    gone = datasets.where(F.col("status").isin(AVAILABLE, ERROR)).join(names, datasets["id"] == names["id"], "left_semi").select("id")
    left = datasets.join(gone, "id", "left_anti")
    ids = gone.select(F.col("id").alias("dataset_id"))
    return left, aliases.join(ids, "dataset_id", "left_anti")
