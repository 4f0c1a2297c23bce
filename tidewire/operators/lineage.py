"""Cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that drops a query's shuffle files when the query ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's switch that deletes the files of a checkpoint that nothing refers to.
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a local one on a single machine; elsewhere an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidewire-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


class shuffles_dropped:
    """Within this block, the shuffle files of every query go when it ends: what it wrote is in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(_DROP_SHUFFLES, "false")
        self.conf.set(_DROP_SHUFFLES, "true")

    def __exit__(self, *_: object) -> None:
        self.conf.set(_DROP_SHUFFLES, self.before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (survives lost executors). The files go when nothing refers to
    the rows any more (the driver's garbage collection tells), unless the session says that checkpoints are to be kept."""
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().setIfMissing(_CLEAN, "true")
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder of the shared store (none where it is missing)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []
