"""Evaluation of volatility estimates, bands, crossovers and disclosed trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import ranks, scan, stats
from ..functions import windows as w
from . import candles, joins
from . import study as S
from . import volatility as V
from .tradeplan import quantile_of_sorted

H = 5
Z = 1.96


def with_targets(df: DataFrame, h: int = H) -> DataFrame:
    """Volatility columns plus the realised variance and log move of the next
    ``h`` bars."""
    keep = df.columns
    x = V.with_ewma_var(V.prepared(df))
    x = x.withColumns(
        {
            "cc": V.ESTIMATORS["close_to_close"](V.WINDOW),
            "ewma": F.sqrt("ewma_var"),
            "yz": V.ESTIMATORS["yang_zhang"](V.WINDOW),
            "blend": V.blend(),
            "rvar": F.sum(F.col("__r") ** 2).over(w.ahead(1, h)),
            "move": w.ln(w.ratio(w.lead("close", h), "close")),
            "i": w.bar_no(),
        }
    )
    return x.select(*keep, "i", "cc", "ewma", "yz", "blend", "rvar", "move")


NAMES = ["cc", "ewma", "yz", "blend"]


def qlike(rvar: Column, sigma: Column, h: int) -> Column:
    r = w.ratio(rvar, sigma**2 * h)
    return F.when(r > 0, r - F.log(r) - 1)


def vol_eval(df: DataFrame, h: int = H) -> DataFrame:
    """QLIKE, Spearman rank correlation, coverage and width per estimator."""
    x = with_targets(df, h).where((F.col("i") >= V.WINDOW + 30) & F.col("move").isNotNull())
    rows = x.unpivot(["symbol", "ts", "rvar", "move"], NAMES, "estimator", "sigma").where(F.col("sigma") > 0)
    s = F.col("sigma")
    rows = rows.withColumns({"q": qlike(F.col("rvar"), s, h), "size": F.abs("move"), "band": Z * s * math.sqrt(h)})
    rows = session.keep(rows)
    g = rows.groupBy("estimator").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("q").alias("qlike"),
        stats.rate(F.col("size") <= F.col("band")).alias("coverage"),
        F.avg(2 * F.col("band")).alias("width"),
    )
    rf = ranks.average_ranks(rows, ["estimator"], "sigma", "rank_s")
    rm = ranks.average_ranks(rows, ["estimator"], "size", "rank_m")
    both = rows.select("estimator", "sigma", "size").join(rf, ["estimator", "sigma"]).join(rm, ["estimator", "size"])
    c = both.groupBy("estimator").agg(stats.corr("rank_s", "rank_m").alias("spearman"))
    return g.join(c, "estimator")


def band_eval(df: DataFrame, h: int = H, window: int = 504) -> DataFrame:
    """Coverage and width of three bands; the adaptive one takes its multiplier
    from the finished moves of the trailing ``window`` bars."""
    x = with_targets(df, h)
    x = x.withColumn("__u", F.when(F.col("blend") > 0, F.abs(F.col("move") / (F.col("blend") * math.sqrt(h)))))
    past = w.by().rowsBetween(-(window + h), -(h + 1))
    x = x.withColumn("__us", F.collect_list("__u").over(past))
    x = x.where((F.col("i") >= V.WINDOW + 40) & F.col("move").isNotNull())
    q = quantile_of_sorted(F.col("__us"), 0.95)
    x = x.withColumn("__us", F.array_sort("__us")).withColumn(
        "z", F.when(F.size("__us") >= 60, w.clip(q, Z, 2.6)).otherwise(Z)
    )
    root = math.sqrt(h)
    cells = [
        F.struct(F.lit("cc_fixed").alias("band"), (Z * F.col("cc") * root).alias("half")),
        F.struct(F.lit("blend_fixed").alias("band"), (Z * F.col("blend") * root).alias("half")),
        F.struct(F.lit("blend_adaptive").alias("band"), (F.col("z") * F.col("blend") * root).alias("half")),
    ]
    rows = x.select("move", F.inline(F.array(*cells))).where(F.col("half").isNotNull())
    return rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        stats.rate(F.abs("move") <= F.col("half")).alias("coverage"),
        F.avg(2 * F.col("half")).alias("width"),
    )


def category_vol_study(df: DataFrame, category: str = "sector", h: int = H) -> DataFrame:
    """Per category: mean volatility, excess kurtosis of the standardised moves,
    coverage, the exact 95% multiplier and the best estimator by QLIKE."""
    x = with_targets(df, h).where((F.col("i") >= V.WINDOW + 40) & F.col("move").isNotNull())
    x = x.withColumn("z", F.when(F.col("blend") > 0, F.col("move") / (F.col("blend") * math.sqrt(h))))
    x = session.keep(x.withColumn("az", F.abs("z")))
    g = x.groupBy(category).agg(
        F.count("z").alias("n"),
        F.avg(F.when(F.col("blend") > 0, F.col("blend"))).alias("daily_vol"),
        F.kurtosis("z").alias("kurtosis"),
        stats.rate(F.col("az") <= Z).alias("coverage"),
        *[F.avg(F.when(F.col(m) > 0, qlike(F.col("rvar"), F.col(m), h))).alias(f"q_{m}") for m in NAMES],
    )
    best = F.array_min(F.array(*[F.struct(F.col(f"q_{m}").alias("q"), F.lit(m).alias("m")) for m in NAMES]))
    q = ranks.exact_quantiles(x, [category], "az", {"z95": 0.95})
    return g.join(q, category).select(
        category, "n", "daily_vol", "kurtosis", "coverage", "z95", best["m"].alias("best_estimator"), best["q"].alias("best_qlike")
    )


def crossover_states(df: DataFrame, h: int = 21) -> DataFrame:
    x = scan.ema(
        df, {"e55": ("close", 55), "e89": ("close", 89), "e204": ("close", 204), "__f": ("close", 13), "__s": ("close", 34)}
    )
    m = F.col("__f") - F.col("__s")
    bull = (F.col("e55") > F.col("e89")) & (F.col("e89") > F.col("e204")) & (m > 0) & (F.col("close") > F.col("e55"))
    bear = (F.col("e55") < F.col("e89")) & (F.col("e89") < F.col("e204")) & (m < 0) & (F.col("close") < F.col("e55"))
    x = x.withColumns({"buy": bull, "sell": bear, "fwd": w.ret(w.lead("close", h), "close"), "i": w.bar_no()})
    # the first 209 bars warm the slowest mean up
    return x.where(F.col("i") >= 209).withColumns(
        {"fresh": F.col("buy") & ~F.coalesce(w.lag("buy"), F.lit(False)), "before": w.lag(F.when(F.col("buy"), "buy").when(F.col("sell"), "sell").otherwise("neutral"))}
    )


def crossover_hit_rate(df: DataFrame, bump: float = 0.15) -> DataFrame:
    """How often a large rise or fall follows any bar, a live buy state and a
    fresh flip to buy."""
    x = crossover_states(df).where(F.col("fwd").isNotNull())
    cell = lambda name, c: F.when(c, F.lit(name))
    sets = F.filter(F.array(F.lit("any"), cell("buy", F.col("buy")), cell("fresh_buy", F.col("fresh"))), lambda v: v.isNotNull())
    f = F.col("fwd")
    return x.withColumn("state", F.explode(sets)).groupBy("state").agg(
        F.count(f).alias("n"),
        stats.rate(f >= bump).alias("bump_rate"),
        stats.rate(f <= -bump).alias("crash_rate"),
        F.avg(f).alias("mean_fwd"),
    )


def largest_moves(df: DataFrame) -> DataFrame:
    """Each symbol's largest forward move and the state on the bar before it."""
    x = crossover_states(df).where(F.col("fwd").isNotNull())
    best = F.max_by(F.struct("ts", "fwd", "before"), F.struct(F.col("fwd"), -F.col("i"))).alias("b")
    return x.groupBy("symbol").agg(best).select(
        "symbol", F.col("b.ts").alias("start_ts"), F.col("b.fwd").alias("move"), F.coalesce("b.before", F.lit("neutral")).alias("state_before")
    )


def disclosure_signals(trades: DataFrame, bars: DataFrame, benchmark: DataFrame, horizons=(21, 63), watch: int = 120, tol: float = 0.02) -> DataFrame:
    """For each disclosed purchase: the first bar within ``tol`` of the buyer's
    own price in ``watch`` bars after disclosure, and what followed against the
    benchmark.

    Every bar carries its next ``watch`` closes as a bounded array, so a trade
    needs two as-of lookups and one equi-join on (symbol, bar number)."""
    top = max(horizons)
    b = bars.select("symbol", "ts", "close").withColumns({"i": w.bar_no(), "n": w.n_bars()})
    b = b.withColumn("next", F.collect_list("close").over(w.by().rowsBetween(0, watch - 1)))
    t = trades.select(
        "symbol", F.col("transaction_date").alias("ts"), "disclosure_date"
    )
    t = joins.asof_backward(t, b.select("symbol", "ts", "close"), ["symbol"], ["close"]).select(
        "symbol", F.col("disclosure_date").alias("ts"), F.col("close").alias("entry")
    )
    t = joins.asof_forward(t.where(F.col("entry") > 0), b.select("symbol", "ts", "i", "n", "next"), ["symbol"], ["i", "n", "next"])
    t = t.where(F.col("n") - F.col("i") >= top + 5)
    near = F.array_position(F.transform("next", lambda c: F.abs(c / F.col("entry") - 1.0) <= tol), True)
    t = t.withColumn("__k", near).where(F.col("__k") > 0)
    t = t.select("symbol", (F.col("i") + F.col("__k") - 1).alias("i"), "entry")
    fwd = S.forward(b.select("symbol", "ts", "close", "i"), horizons).where(F.col(f"fwd_{top}").isNotNull())
    hit = t.join(fwd.select("symbol", "i", "ts", *[f"fwd_{h}" for h in horizons]), ["symbol", "i"])
    # the benchmark is one calendar-sized series: match each distinct date once
    m = benchmark.withColumn("symbol", F.lit("benchmark"))
    m = S.forward(m, horizons).select("symbol", "ts", *[F.col(f"fwd_{h}").alias(f"bench_{h}") for h in horizons])
    days = hit.select("ts").distinct().withColumn("symbol", F.lit("benchmark"))
    at = joins.nearest(days, m, ["symbol"], [f"bench_{h}" for h in horizons], unit="year").drop("symbol", "match_ts")
    return hit.join(at, "ts").where(F.col(f"bench_{top}").isNotNull())


def disclosure_return_study(signals: DataFrame, horizons=(21, 63)) -> DataFrame:
    cells = [
        F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("s"), F.col(f"bench_{h}").alias("m")) for h in horizons
    ]
    rows = signals.select(F.inline(F.array(*cells))).withColumn("d", F.col("s") - F.col("m"))
    return rows.groupBy("horizon").agg(
        F.count("d").alias("n"),
        F.avg("s").alias("mean_ret"),
        F.avg("m").alias("bench_ret"),
        F.avg("d").alias("edge"),
        stats.t_of("d").alias("t"),
        stats.rate(F.col("d") > 0).alias("win_vs_bench"),
    )


def candle_backtest(df: DataFrame, horizons=(5, 10, 20), min_samples: int = 5, tail: int | None = None, keys=("symbol",)) -> DataFrame:
    """Per symbol, pattern and horizon: samples, win rate in the pattern's
    direction, mean return, and edge over the symbol's own base rate."""
    keys = list(keys)
    x = candles.with_hits(df)
    if tail:
        # lagged geometry of the first bars stays inside the window, as on a cut frame
        x = candles.with_hits(df.withColumn("__a", w.bars_ago()).where(F.col("__a") < tail).drop("__a"))
    x = S.forward(x, horizons)
    base = x.groupBy(*keys).agg(
        F.count("close").alias("__n"),
        *[F.avg((F.col(f"fwd_{h}") > 0).cast("double")).alias(f"__u{h}") for h in horizons],
    ).where(F.col("__n") >= max(horizons) + 30)
    ev = x.select(*keys, *[f"fwd_{h}" for h in horizons], F.inline("hits"))
    cells = [F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons]
    rows = ev.select(*keys, "name", "bias", F.inline(F.array(*cells)))
    won = F.when(F.col("bias") == "bearish", F.col("fwd") < 0).otherwise(F.col("fwd") > 0)
    g = rows.groupBy(*keys, "name", "bias", "horizon").agg(
        F.count(F.lit(1)).alias("count"),
        F.count("fwd").alias("samples"),
        F.avg(F.when(F.col("fwd").isNotNull(), won.cast("double"))).alias("win_rate"),
        F.avg("fwd").alias("avg_return"),
    )
    up = F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"__u{h}")) for h in horizons])
    ref = F.when(F.col("bias") == "bearish", 1.0 - up).otherwise(up)
    return (
        g.join(base, keys)
        .where((F.col("count") >= min_samples) & (F.col("samples") > 0))
        .select(*keys, "name", "bias", "horizon", "count", "samples", "win_rate", "avg_return", (F.col("win_rate") - ref).alias("edge"), up.alias("base_up"))
    )
