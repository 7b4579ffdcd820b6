"""Tables that change as a whole: data is staged, then one small file publishes it.

A snapshot is a manifest, a numbered file that names the folder of every part.
Writers stage new folders and create the next number; creating a file that exists
fails, so of two writers that read the same snapshot one gets ``Conflict``.  A
crash before that leaves the old snapshot, a crash after it the new one; a
manifest without its last line counts as never written.  Nothing published is
overwritten."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_END = "published"
_PART = "__part"


class Conflict(RuntimeError):
    """Another writer published in between."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/_manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The highest number taken, and the part folders of the newest complete manifest."""
    numbers = _numbers(spark, path)
    for n in reversed(numbers):
        lines = [r.value for r in spark.read.text(f"{path}/_manifest/{n:012d}").collect()]
        if lines and lines[-1] == _END:
            return numbers[-1], json.loads(lines[0])
    return (numbers[-1] if numbers else 0), {}


def publish(spark: SparkSession, path: str, seen: int, parts: dict[str, str]) -> int:
    """Makes ``parts`` the snapshot that follows number ``seen``."""
    fs, target = _fs(spark, f"{path}/_manifest/{seen + 1:012d}")
    try:
        out = fs.create(target, False)
    except Exception as e:
        # A local file system reports an existing file by another exception than a remote one.
        if fs.exists(target):
            raise Conflict(f"snapshot {seen + 1} of {path} is already published") from e
        raise
    out.write(f"{json.dumps(parts, sort_keys=True)}\n{_END}\n".encode())
    out.close()
    return seen + 1


def stage(df: DataFrame, path: str, part: Column | None = None) -> dict[str, str]:
    """Writes ``df`` to folders of its own, one for each value of ``part`` (text), and names them; readers see nothing yet."""
    folder = f"data/{uuid.uuid4().hex}"
    if part is None:
        df.write.parquet(f"{path}/{folder}")
        return {"all": folder}
    df.withColumn(_PART, part.cast("string")).repartition(_PART).write.partitionBy(_PART).parquet(f"{path}/{folder}")
    fs, at = _fs(df.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{_PART}=")}


def read(spark: SparkSession, path: str, schema: StructType, only: list[str] | None = None) -> DataFrame:
    """The published rows, or those of some parts."""
    parts = current(spark, path)[1]
    folders = [f"{path}/{f}" for p, f in sorted(parts.items()) if only is None or p in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str, part: Column | None = None) -> int:
    """Stages ``df`` and publishes it in place of the parts it has; other parts stay."""
    spark = df.sparkSession
    seen, parts = current(spark, path)
    return publish(spark, path, seen, (parts if part is not None else {}) | stage(df, path, part))
