"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale. Partition counts and memory are left to the
# cluster's own configuration; AQE coalesces and splits shuffles at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows that carry a whole text to Python travel in small batches
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` entries use ``_`` for ``.``."""
    builder = SparkSession.builder.appName("marginalia")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be unreadable from other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables one job hands to the next."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there.

    A written table rather than an RDD checkpoint: later stages read only the
    columns and row groups they need, and a lost executor costs a re-read.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt ahead of heavy work on each: every core has some."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# Rows of a task that sorts them several times over without spilling.
TASK_ROWS = 100_000


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to enough tasks for ``rows`` rows; without a number Spark's own choice holds.

    Spark joins small partitions until they have 64 MB, which chains of sorts cannot hold.
    """
    if rows is None:
        return df.repartition(*keys)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // TASK_ROWS)), *keys)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, whatever folder the driver was started from.

    Once per Spark context; Spark serves the archive from the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="marginalia-code-")) / "marginalia.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._marginalia_shipped = True
