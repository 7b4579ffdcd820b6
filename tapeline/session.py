"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tapeline", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TAPELINE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local one is made only where none is named and the session runs
    in local mode; a cluster without the setting is an error, because executors
    could not read a local folder back after a loss."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tapeline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate that a plan reads more than once.

    Memory first, then disk; a lost executor's part is recomputed from lineage.
    Besides the second computation this saves planning: readers see one leaf
    instead of a copy of everything upstream."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Unpersist everything kept so far."""
    while _KEPT:
        _KEPT.pop().unpersist()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so a lost executor reruns nothing upstream."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once into the shared folder and read it back.

    Readers get a pruned columnar scan and a short plan; after an executor loss
    only the scan repeats, not the work upstream."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
