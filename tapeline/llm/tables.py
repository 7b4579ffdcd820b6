"""Stored intermediates and row keys shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import as_table

__all__ = ["as_table", "crc_mod", "drop_table", "fresh", "with_row"]


def drop_table(df: DataFrame) -> None:
    """Deletes what ``as_table`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Numbers the rows of a stored table.

    The number is a partition and a position, so two scans of the same files
    agree; ids may be null or repeated, rows still differ."""
    return df.withColumn(name, F.monotonically_increasing_id())


def crc_mod(id_col: str, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
