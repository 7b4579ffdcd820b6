"""The event-study harness: any set of masks x horizons in one job.

Rows are expanded to (signal, horizon) only where they count: on a hit, or on
a sampled date, where unselected symbols form the comparison group.  The first
aggregation is by (signal, horizon, date) with map-side combine; the second is
over dates, so no group ever holds raw rows of more than one date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import ranks, stats
from ..functions import windows as w
from ..sources import bars as B

START = 260
MIN_N = 20
BIG_WIN = 0.20


def forward(df: DataFrame, horizons: Sequence[int], c: str = "close") -> DataFrame:
    return df.withColumns({f"fwd_{h}": w.ret(w.lead(c, h), c) for h in horizons})


def sampled(h: int, start: int = START) -> Column:
    """Every h-th date of the union calendar: windows never overlap in time."""
    ci = F.col("ci")
    return (ci >= start) & (ci < F.col("cn") - h) & ((ci - start) % h == 0)


def expand(
    panel: DataFrame,
    masks: Mapping[str, Column],
    horizons: Sequence[int],
    start: int = START,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long rows (signal, horizon, ts, hit, sampled, fwd)."""
    x = B.with_calendar(forward(panel, horizons))
    names = {f"__m{i}": c for i, c in enumerate(masks.values())}
    x = x.withColumns(names)
    cells = [
        F.struct(
            F.lit(name).alias("signal"),
            F.lit(h).cast("long").alias("horizon"),
            F.col(f"__m{i}").alias("hit"),
            w.flag(sampled(h, start)).alias("sampled"),
            F.col(f"fwd_{h}").alias("fwd"),
        )
        for i, name in enumerate(masks)
        for h in horizons
    ]
    live = F.filter(F.array(*cells), lambda s: s["fwd"].isNotNull() & (s["hit"] | s["sampled"]))
    return x.select("symbol", "ts", *keep, F.inline(live))


def by_date(rows: DataFrame, keys: Sequence[str], pooled_on_sample: bool = False) -> DataFrame:
    hit = F.col("hit") & F.col("sampled") if pooled_on_sample else F.col("hit")
    fwd = F.col("fwd")

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return rows.groupBy(*keys, "ts").agg(
        n(hit).alias("n"),
        F.sum(F.when(hit, fwd)).alias("s"),
        n(hit & (fwd > 0)).alias("wins"),
        n(hit & (fwd > BIG_WIN)).alias("big"),
        n(hit & (fwd < 0)).alias("duds"),
        F.min(F.when(hit, fwd)).alias("worst"),
        F.avg(F.when(F.col("hit") & F.col("sampled"), fwd)).alias("sel"),
        F.avg(F.when(~F.col("hit") & F.col("sampled"), fwd)).alias("rest"),
    )


def summarise(dates: DataFrame, keys: Sequence[str]) -> DataFrame:
    diff = F.col("sel") - F.col("rest")
    g = dates.withColumn("diff", diff).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("__s"),
        F.sum("wins").alias("__w"),
        F.sum("big").alias("__b"),
        F.sum("duds").alias("__d"),
        F.min("worst").alias("worst"),
        F.avg("diff").alias("diff_mean"),
        stats.t_of("diff").alias("t"),
        F.count("diff").alias("n_dates"),
    )
    return g.select(
        *keys,
        "n",
        w.ratio("__s", "n").alias("mean_ret"),
        w.ratio("__w", "n").alias("win_rate"),
        w.ratio("__b", "n").alias("big_win_rate"),
        w.ratio("__d", "n").alias("dud_rate"),
        "worst",
        (F.col("n") >= MIN_N).alias("powered"),
        "diff_mean",
        "t",
        "n_dates",
    )


def run_study(
    panel: DataFrame,
    masks: Mapping[str, Column],
    horizons: Sequence[int],
    start: int = START,
    pooled_on_sample: bool = False,
    quantiles: bool = False,
) -> DataFrame:
    """Per signal and horizon: pooled hit statistics, and the per-date mean
    difference against unselected symbols with its t over sampled dates."""
    keys = ["signal", "horizon"]
    rows = expand(panel, masks, horizons, start)
    if quantiles:
        rows = session.keep(rows)
    out = summarise(by_date(rows, keys, pooled_on_sample), keys)
    if quantiles:
        hits = rows.where(F.col("hit") & F.col("sampled") if pooled_on_sample else F.col("hit"))
        out = out.join(ranks.exact_quantiles(hits, keys, "fwd", {"median": 0.5, "p25": 0.25}), keys, "left")
    return out


def mask_vs_mask(panel: DataFrame, pairs: Mapping[str, tuple[Column, Column]], horizons: Sequence[int], start: int = START) -> DataFrame:
    """Mean of A minus mean of B on the sampled dates both have, and its t."""
    x = B.with_calendar(forward(panel, horizons))
    cells = []
    for name, (a, b) in pairs.items():
        for h in horizons:
            cells.append(
                F.struct(
                    F.lit(name).alias("pair"),
                    F.lit(h).cast("long").alias("horizon"),
                    w.flag(a).alias("a"),
                    w.flag(b).alias("b"),
                    w.flag(sampled(h, start)).alias("sampled"),
                    F.col(f"fwd_{h}").alias("fwd"),
                )
            )
    live = F.filter(F.array(*cells), lambda s: s["fwd"].isNotNull() & (s["a"] | s["b"]))
    rows = x.select("ts", F.inline(live))
    d = rows.groupBy("pair", "horizon", "ts").agg(
        F.sum(F.when(F.col("a"), F.col("fwd"))).alias("sa"),
        F.count(F.when(F.col("a"), 1)).alias("na"),
        F.sum(F.when(F.col("b"), F.col("fwd"))).alias("sb"),
        F.count(F.when(F.col("b"), 1)).alias("nb"),
        F.max("sampled").alias("sampled"),
    )
    diff = F.when(F.col("sampled"), w.ratio("sa", "na") - w.ratio("sb", "nb"))
    return d.withColumn("diff", diff).groupBy("pair", "horizon").agg(
        w.ratio(F.sum("sa"), F.sum("na")).alias("mean_a"),
        w.ratio(F.sum("sb"), F.sum("nb")).alias("mean_b"),
        F.avg("diff").alias("diff_mean"),
        stats.t_of("diff").alias("t"),
        F.count("diff").alias("n_dates"),
    )


def regime_split(
    panel: DataFrame,
    masks: Mapping[str, Column],
    h: int,
    buckets: DataFrame,
    start: int = START,
) -> DataFrame:
    """The study split by date bucket.  ``buckets`` is a small named table of
    closed date intervals (bucket, lo, hi); a date may fall into several."""
    rows = expand(panel, masks, [h], start)
    d = by_date(rows, ["signal", "horizon"])
    # the interval table is a handful of user-named rows
    hit = d.join(F.broadcast(buckets), (F.col("ts") >= F.col("lo")) & (F.col("ts") <= F.col("hi")))
    return summarise(hit, ["signal", "bucket"])


def firing_by_year(panel: DataFrame, masks: Mapping[str, Column], h: int) -> DataFrame:
    rows = expand(panel, masks, [h]).where("hit")
    return rows.groupBy("signal", F.year("ts").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def baseline_returns(panel: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Unconditional forward returns: n, mean, exact median and win rate."""
    x = forward(panel, horizons)
    rows = x.select(
        F.inline(
            F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])
        )
    ).where(F.col("fwd").isNotNull())
    rows = session.keep(rows)
    g = rows.groupBy("horizon").agg(
        F.count("fwd").alias("n"), F.avg("fwd").alias("mean_ret"), stats.rate(F.col("fwd") > 0).alias("win_rate")
    )
    return g.join(ranks.exact_quantiles(rows, ["horizon"], "fwd", {"median": 0.5}), "horizon")
