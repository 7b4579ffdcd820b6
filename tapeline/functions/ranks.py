"""Exact ranks and quantiles of groups that may hold any share of the rows.

``percentile`` and a rank window both gather a whole group in one task.  Here
a group is cut at approximate quantiles (a bounded sketch), so each (group,
bucket) is small, and bucket offsets are prefix sums over a tiny table.  A
bucket is cut again in the next pass: BUCKETS ** PASSES buckets in all, of which
a quantile reads the few that hold its ranks, and only those rows go into the
next pass.  Results are exact; the sketches decide only where to cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a pass, and passes: a group of 10**11 distinct values ends in buckets of some 25 million.
BUCKETS, PASSES = 64, 2


def _ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct (keys, value) with a tie count.

    Grouping by the value first is the map-side combine that keeps one hot
    value from becoming one hot bucket.  Cut points come from the distinct
    values, and every branch reads the tie count, so all of them share the one
    exchange of the first aggregation."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__ties"))
    return ties.where(F.col("__ties") > 0)


def _cut(x: DataFrame, own: Sequence[str], value: str, name: str, buckets: int) -> DataFrame:
    """A bucket number inside each group of ``own``, by the group's approximate quantiles."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = x.groupBy(*own).agg(F.array_distinct(F.percentile_approx(value, probs, 1000)).alias("__cuts"))
    return x.join(cuts, list(own)).withColumn(name, F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def _offsets(cut: DataFrame, keys: Sequence[str], marks: Sequence[str]) -> DataFrame:
    per = cut.groupBy(*keys, *marks).agg(F.sum("__ties").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(*marks)
    return per.select(
        *keys,
        *marks,
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        F.col("__n"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, buckets: int = BUCKETS, passes: int = PASSES) -> DataFrame:
    """Distinct (keys, value) with the average rank of its ties in ``out``."""
    x, marks = _ties(df, keys, value), []
    for p in range(passes):
        x = _cut(x, [*keys, *marks], value, f"__b{p}", buckets)
        marks.append(f"__b{p}")
    w = Window.partitionBy(*keys, *marks).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(_offsets(x, keys, marks), [*keys, *marks]).select(
        *keys,
        value,
        (
            F.col("__before")
            + F.coalesce(F.sum("__ties").over(w), F.lit(0))
            + (F.col("__ties") + 1) / F.lit(2.0)
        ).alias(out),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    buckets: int = BUCKETS,
    passes: int = PASSES,
) -> DataFrame:
    """Linear-interpolated quantiles per group: one row per key, one column per
    entry of ``probs``."""

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__total") - 1)

    wanted = F.lit(False)
    for p in probs.values():
        end = F.col("__before") + F.col("__n")
        wanted = wanted | ((F.col("__before") <= F.ceil(position(p))) & (end > F.floor(position(p))))
    x, own = _ties(df, keys, value), list(keys)
    for p in range(passes):
        mark = f"__b{p}"
        x = _cut(x, own, value, mark, buckets)
        if p == 0:
            offs = _offsets(x, own, [mark]).where(wanted)
        else:
            # Ranks go on from where the bucket above begins.
            per = x.groupBy(*own, mark).agg(F.sum("__ties").alias("__n"), F.first("__before").alias("__above"), F.first("__total").alias("__total"))
            past = Window.partitionBy(*own).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
            before = F.col("__above") + F.coalesce(F.sum("__n").over(past), F.lit(0))
            offs = per.withColumn("__before", before).drop("__above").where(wanted)
            x = x.drop("__before", "__total")
        own.append(mark)
        x = x.join(offs.drop("__n"), own)
    w = Window.partitionBy(*own).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = x.withColumn("__r", F.col("__before") + F.coalesce(F.sum("__ties").over(w), F.lit(0)))

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("__r") <= pos) & (F.col("__r") + F.col("__ties") > pos), F.col(value)))

    aggs = []
    for name, p in probs.items():
        lo, hi = F.floor(position(p)), F.ceil(position(p))
        frac = F.max(position(p) - F.floor(position(p)))
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
