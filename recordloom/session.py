"""Session settings used by the tests and the benchmark.

On a cluster the caller brings a session; nothing in the package depends on
the settings below except that timestamps are compared in UTC.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "recordloom", partitions: int | None = None) -> SparkSession:
    n = partitions or (cores if isinstance(cores, int) else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RECORDLOOM_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}  # folder of each local application that has no setting


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    ``spark.checkpoint.dir`` names it on a cluster. A machine-local folder is
    only made where the setting is absent and the session is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="recordloom-")
    return _LOCAL[app]


def fresh_folder(spark: SparkSession, label: str = "work") -> str:
    """A new, unused path under the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/recordloom/{label}-{uuid.uuid4().hex}"
