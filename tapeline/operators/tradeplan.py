"""Volatility-scaled targets from the empirical path distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from . import volatility as V

WINDOW = 252
MIN_SAMPLES = 40
Q_SAFE, Q_STRETCH, Q_STOP = 0.34, 0.50, 0.34


def with_excursions(df: DataFrame, h: int) -> DataFrame:
    """Best and worst price of the next ``h`` bars against the close, raw and in
    units of the bar's volatility; NULL until all ``h`` bars exist."""
    f = w.ahead(1, h)
    done = F.count("close").over(f) == h
    x = df.withColumns(
        {
            "mfe": F.when(done, w.ret(F.max("high").over(f), "close")),
            "mae": F.when(done, w.ret(F.min("low").over(f), "close")),
            "end_ret": w.ret(w.lead("close", h), "close"),
        }
    )
    s = F.when(F.col("sigma") > 0, F.col("sigma") * math.sqrt(h))
    return x.withColumns({"sig_h": s, "mfe_z": F.col("mfe") / s, "mae_z": F.col("mae") / s})


def _levels(entry: Column, safe: Column, stretch: Column, stop: Column, raw: Column, med: Column) -> dict[str, Column]:
    now = F.greatest(0.5 * med, F.least(2.0 * med, raw))
    r = F.when(med > 0, raw / med).otherwise(1.0)
    return {
        "target_ret": safe * now,
        "stretch_ret": stretch * now,
        "stop_ret": stop * now,
        "target": entry * (1 + safe * now),
        "stretch": entry * (1 + stretch * now),
        "stop": entry * (1 + stop * now),
        "vol_ratio": r,
        "weekly_vol": now,
        "regime": F.when(r > 1.25, "elevated").when(r < 0.8, "calm").otherwise("normal"),
    }


def trade_plan(df: DataFrame, h: int = 5, window: int = WINDOW) -> DataFrame:
    """One row per symbol.  The sample is the last ``window`` finished windows,
    a bounded group, so exact percentiles are safe here."""
    x = with_excursions(V.with_blend(df), h).withColumn("__a", w.bars_ago())
    use = F.col("__a").between(h, h + window - 1) & F.col("sig_h").isNotNull()

    def in_sample(c: str) -> Column:
        return F.when(use, F.col(c))

    g = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        F.count(in_sample("mfe_z")).alias("samples"),
        F.max(F.when(F.col("__a") == 0, F.col("close"))).alias("entry"),
        (F.max_by("sigma", F.when(F.col("sigma").isNotNull(), F.col("ts"))) * math.sqrt(h)).alias("__raw"),
        F.percentile(in_sample("sig_h"), F.lit(0.5)).alias("__med"),
        F.percentile(in_sample("mfe_z"), F.lit(Q_SAFE)).alias("__safe"),
        F.percentile(in_sample("mfe_z"), F.lit(Q_STRETCH)).alias("__stretch"),
        F.percentile(in_sample("mae_z"), F.lit(Q_STOP)).alias("__stop"),
        F.avg((in_sample("mfe") > 0).cast("double")).alias("p_profit_intraperiod"),
        F.avg((in_sample("end_ret") > 0).cast("double")).alias("p_profit_at_close"),
    ).where((F.col("__n") >= h + 80) & (F.col("samples") >= MIN_SAMPLES))
    cols = _levels(*[F.col(c) for c in ("entry", "__safe", "__stretch", "__stop", "__raw", "__med")])
    return g.withColumns(cols).select("symbol", "entry", "samples", "p_profit_intraperiod", "p_profit_at_close", *cols)


def quantile_of_sorted(a: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    pos = F.lit(p) * (F.size(a) - 1)
    lo = F.floor(pos).cast("int")
    v0 = F.get(a, lo)
    v1 = F.get(a, F.ceil(pos).cast("int"))
    return v0 + (v1 - v0) * (pos - lo)


def plan_series(df: DataFrame, h: int = 5, window: int = WINDOW, every: int = 1, start: int = 0) -> DataFrame:
    """The plan as it was known on every ``every``-th bar from ``start``.

    The sample of a bar is a frame ending ``h`` bars back, carried as a bounded
    array; nothing after the bar is read."""
    x = with_excursions(V.with_blend(df), h).withColumn("i", w.bar_no())
    past = w.by().rowsBetween(-(h + window - 1), -h)
    ok = F.col("sig_h").isNotNull()
    x = x.withColumns(
        {
            "__mfe": F.collect_list(F.when(ok, F.col("mfe_z"))).over(past),
            "__mae": F.collect_list(F.when(ok, F.col("mae_z"))).over(past),
            "__sig": F.collect_list(F.when(ok, F.col("sig_h"))).over(past),
            "__win": F.avg(F.when(ok, (F.col("mfe") > 0).cast("double"))).over(past),
        }
    )
    x = x.where((F.col("i") >= F.lit(start)) & ((F.col("i") - start) % every == 0) & (F.col("i") >= h + 79))
    x = x.where((F.size("__mfe") >= MIN_SAMPLES) & ok)
    for c in ("__mfe", "__mae", "__sig"):
        x = x.withColumn(c, F.array_sort(c))
    safe = quantile_of_sorted(F.col("__mfe"), Q_SAFE)
    stretch = quantile_of_sorted(F.col("__mfe"), Q_STRETCH)
    stop = quantile_of_sorted(F.col("__mae"), Q_STOP)
    med = quantile_of_sorted(F.col("__sig"), 0.5)
    cols = _levels(F.col("close"), safe, stretch, stop, F.col("sig_h"), med)
    return x.withColumns(cols).select("symbol", "ts", "i", "close", "mfe", "end_ret", F.col("__win").alias("p_profit"), *cols)


def target_calibration(df: DataFrame, h: int = 5, every: int = 3, start: int = 300, fixed: float = 0.03) -> DataFrame:
    """How often the scaled target, a fixed target and any profit were reached."""
    p = plan_series(df, h, every=every, start=start).where(F.col("mfe").isNotNull())
    rate = lambda c: F.avg(c.cast("double"))
    return p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("target_ret").alias("avg_target"),
        rate(F.col("mfe") >= F.col("target_ret")).alias("target_hit"),
        rate(F.col("mfe") >= fixed).alias("fixed_hit"),
        rate(F.col("mfe") > 0).alias("p_green"),
    )
