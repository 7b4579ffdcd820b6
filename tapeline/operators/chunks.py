"""The same windows for few symbols with very long histories.

A window partition is one task.  Here a symbol's history is cut into chunks of
bars; a finite window sees its chunk plus a halo of the last rows of the one
before, so the work spreads over (symbol, chunk) and stays exact.  Ordinals
come from prefix counts, and running totals from per-chunk totals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan

CHUNK = 4096


def with_ordinal(df: DataFrame, unit: str = "month", out: str = "i") -> DataFrame:
    """0-based bar number per symbol without a whole-symbol sort.

    Bars are counted per (symbol, time slice); slice offsets are prefix sums
    over that small table; inside a slice the order is a bounded window."""
    x = df.withColumn("__s", F.date_trunc(unit, "ts"))
    n = x.groupBy("symbol", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("symbol").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    off = n.select("symbol", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("symbol", "__s").orderBy("ts")
    return x.join(off, ["symbol", "__s"]).withColumn(out, (F.col("__o") + F.row_number().over(inside) - 1).cast("long")).drop("__s", "__o")


def halo(df: DataFrame, reach: int, size: int = CHUNK) -> DataFrame:
    """Rows with their chunk ``__c``; the last ``reach`` rows of a chunk appear
    again, marked ``__halo``, in the next one.  Needs the ordinal ``i``."""
    if reach > size:
        raise ValueError("the halo must not exceed a chunk")
    c = F.floor(F.col("i") / size)
    late = F.col("i") % size >= size - reach
    copies = F.when(
        late, F.array(F.struct(c.alias("__c"), F.lit(False).alias("__halo")), F.struct((c + 1).alias("__c"), F.lit(True).alias("__halo")))
    ).otherwise(F.array(F.struct(c.alias("__c"), F.lit(False).alias("__halo"))))
    return df.select("*", F.inline(copies))


def rolling(df: DataFrame, columns: Mapping[str, tuple[str, str, int]], size: int = CHUNK) -> DataFrame:
    """Full-window rolling aggregates ``name -> (function, column, window)``
    over chunks; the same values as the plain window path."""
    reach = max(n for _, _, n in columns.values()) - 1
    keep = df.columns if "i" in df.columns else [*df.columns, "i"]
    x = halo(df if "i" in df.columns else with_ordinal(df), reach, size)
    out = {}
    for name, (fn, c, n) in columns.items():
        spec = Window.partitionBy("symbol", "__c").orderBy("i").rowsBetween(-(n - 1), 0)
        out[name] = F.when(F.count(c).over(spec) >= n, getattr(F, fn)(c).over(spec))
    return x.withColumns(out).where(~F.col("__halo")).select(*keep, *out)


def running_sum(df: DataFrame, c: str | Column, out: str, size: int = CHUNK) -> DataFrame:
    """Cumulative sum per symbol: local sums inside chunks plus the total of all
    earlier chunks, carried over one row per chunk."""
    keep = df.columns if "i" in df.columns else [*df.columns, "i"]
    x = df if "i" in df.columns else with_ordinal(df)
    x = x.withColumns({"__c": F.floor(F.col("i") / size), "__v": (F.col(c) if isinstance(c, str) else c)})
    tot = x.groupBy("symbol", "__c").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy("symbol").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select("symbol", "__c", F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__b"))
    inside = Window.partitionBy("symbol", "__c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(carry, ["symbol", "__c"]).withColumn(out, F.col("__b") + F.sum("__v").over(inside)).select(*keep, out)


def ewm(df: DataFrame, c: str, alpha: float, out: str, size: int = 256) -> DataFrame:
    """Exponential mean per symbol spread over (symbol, chunk).

    Chunk ends form a table ``size`` times smaller; the carry of the plain scan
    runs on it with the decay of a whole chunk and joins back."""
    q = 1.0 - alpha
    size = min(size, scan.chunk_length([alpha]))
    keep = df.columns if "i" in df.columns else [*df.columns, "i"]
    x = df if "i" in df.columns else with_ordinal(df)
    x = x.withColumns({"__c": F.floor(F.col("i") / size), "__k": (F.col("i") % size).cast("double")})
    u = F.when(F.col("i") == 0, F.col(c)).otherwise(F.col(c) * F.lit(alpha))
    inside = Window.partitionBy("symbol", "__c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__l", F.sum(u * F.pow(F.lit(q), -F.col("__k"))).over(inside) * F.pow(F.lit(q), F.col("__k")))
    ends = x.where(F.col("__k") == size - 1).select("symbol", "__c", "__l")
    ends = scan.carried(ends, "__l", "__c", q**size, "__b", ["symbol"], "__c")
    ends = ends.select("symbol", (F.col("__c") + 1).alias("__c"), (F.col("__l") + F.col("__b") * F.lit(q**size)).alias("__b"))
    y = x.join(ends, ["symbol", "__c"], "left")
    return y.withColumn(out, F.col("__l") + F.coalesce("__b", F.lit(0.0)) * F.pow(F.lit(q), F.col("__k") + 1.0)).select(*keep, out)
