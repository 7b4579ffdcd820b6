"""Time joins Spark has no operator for: as-of, nearest and range by bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asof(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str, unit: str, back: bool) -> DataFrame:
    """Union both sides and carry the right value along the time order.

    The order runs inside (keys, time bucket) so a key with a third of all rows
    is spread over its buckets; what crosses a bucket edge is one value per
    bucket, found on the small per-bucket table."""
    keys = list(keys)
    bucket = F.date_trunc(unit, ts).alias("__b")
    lcols = left.columns
    value = F.struct(F.col(ts).alias("match_ts"), *values).alias("__v")
    r = right.where(F.col(ts).isNotNull()).select(*keys, ts, bucket, value)
    edge = F.max_by("__v", ts) if back else F.min_by("__v", ts)
    edges = r.groupBy(*keys, "__b").agg(edge.alias("__edge"))
    slots = left.select(*keys, bucket).distinct().join(edges, [*keys, "__b"], "full")
    order = Window.partitionBy(*keys).orderBy(F.asc("__b") if back else F.desc("__b"))
    carried = slots.select(
        *keys,
        "__b",
        F.last("__edge", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
    )
    payload = F.struct(*[F.col(c) for c in lcols]).alias("__l")
    rows = left.select(*keys, ts, bucket, F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), payload, F.lit(1).alias("__side"))
    marks = r.select("*", F.lit(None).cast(rows.schema["__l"].dataType).alias("__l"), F.lit(0).alias("__side"))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.asc(ts) if back else F.desc(ts), "__side")
    u = rows.unionByName(marks).withColumn("__hit", F.last("__v", ignorenulls=True).over(inside))
    got = u.where(F.col("__side") == 1).join(carried, [*keys, "__b"], "left")
    hit = F.coalesce("__hit", "__carry")
    return got.select("__l.*", hit["match_ts"].alias("match_ts"), *[hit[v].alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts", unit: str = "month") -> DataFrame:
    """Each left row with the newest right row at or before its time."""
    return _asof(left, right, keys, values, ts, unit, True)


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts", unit: str = "month") -> DataFrame:
    """Each left row with the first right row at or after its time."""
    return _asof(left, right, keys, values, ts, unit, False)


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts", unit: str = "month") -> DataFrame:
    """The closer of the two as-of matches; the earlier one on a tie."""
    back = asof_backward(left, right, keys, values, ts, unit)
    names = ["match_ts", *values]
    back = back.select(*left.columns, F.struct(*names).alias("__back"))
    both = asof_forward(back, right, keys, values, ts, unit)
    b, f = F.col("__back"), F.struct(*names)
    gap_b = F.abs(F.unix_micros(ts) - F.unix_micros(b["match_ts"]))
    gap_f = F.abs(F.unix_micros(F.col("match_ts")) - F.unix_micros(ts))
    first = F.col("match_ts").isNull() | (b["match_ts"].isNotNull() & (gap_b <= gap_f))
    return both.withColumn("__n", F.when(first, b).otherwise(f)).select(
        *left.columns, *[F.col("__n")[n].alias(n) for n in names]
    )


def align_series(dates: DataFrame, series: DataFrame, value: str = "close", out: str = "bench") -> DataFrame:
    """One benchmark series read at every given date (forward fill).

    Both inputs are calendar-sized (one row per date), so the ordered fill runs
    over one small partition and the result joins back on ``ts``."""
    u = dates.select("ts").distinct().join(series.select("ts", F.col(value).alias("__v")), "ts", "full")
    spec = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return u.select("ts", F.last("__v", ignorenulls=True).over(spec).alias(out)).where(F.col(out).isNotNull())


def with_benchmark(bars: DataFrame, series: DataFrame, value: str = "close", out: str = "bench") -> DataFrame:
    """Bars with the benchmark's last known value on each bar's date."""
    return bars.join(align_series(bars, series, value, out), "ts", "left")


def bins(lo: Column, hi: Column, width: float) -> Column:
    """Logarithmic price bins touched by the interval [lo, hi]."""
    at = lambda x: F.floor(F.log(x) / F.lit(width)).cast("long")
    return F.sequence(at(lo), at(hi))
