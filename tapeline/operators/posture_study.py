"""The posture as it stood on past bars, and what followed."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import ranks, scan, stats
from ..functions import windows as w
from . import asof_events as A
from . import asof_patterns as AP
from . import candles as C
from . import composites as CO
from . import indicators as I
from . import joins
from . import regimes as R
from . import study as S
from . import volume as VOL

COMPONENTS = list(CO.POSTURE_WEIGHTS)
HORIZONS = (5, 20, 60)
# fixed value: the study reads trend, patterns and volume over a chart of so many bars
CHART = AP.CHART


def _slope(n: int):
    """Least-squares slope of the last ``n`` closes in % of their mean per bar."""
    spec = w.trailing(n)
    x = F.col("__i").cast("double")
    s = w.ratio(F.regr_slope("close", x).over(spec) * 100.0, F.avg("close").over(spec))
    return F.when(F.count("close").over(spec) >= n, s)


def posture_series(bars: DataFrame, benchmark: DataFrame, start: int = 260, every: int = 3, facts: bool = False) -> DataFrame:
    """The ten component values on every ``every``-th bar from ``start``; an absent component is NULL.

    Nothing after the bar is read: frames end on it, candles are scaled by the
    edge their pattern had shown by then, and chart patterns are those of the
    chart that ends there.  ``facts`` adds rsi_value, cross, passes and stage."""
    keep = bars.columns
    x = joins.with_benchmark(bars, benchmark).withColumns({"__i": w.bar_no()})
    x = I.rsi(x)
    x = scan.ema(x, {"__e12": ("close", 12), "__e26": ("close", 26)}).withColumn("__m", F.col("__e12") - F.col("__e26"))
    x = scan.ema(x, {"__ms": ("__m", 9)})
    tail = w.trailing(CHART)
    x = x.withColumns(
        {
            **{f"__s{b}": _slope(b + 1) for _, b in R.HORIZONS},
            **{f"__a{n}": I.sma("close", n) for n in (50, 150, 200)},
            "__sl": _slope(CHART),
            "__r2": F.regr_r2("close", F.col("__i").cast("double")).over(tail),
            "__lo": w.roll(F.min, "close", 252),
            "__hi": w.roll(F.max, "close", 252),
            "__rs": w.ret("close", w.lag("close", 125)) - w.ret("bench", w.lag("bench", 125)),
            "__yr": w.ret("close", w.lag("close", R.TEMPLATE_MIN - 1)),
            "__vol": F.sum(F.coalesce("volume", F.lit(0.0))).over(tail),
        }
    ).withColumn("__a200p", w.lag("__a200", R.TEMPLATE_LAG))
    sampled = lambda i: (F.col(i) >= start) & ((F.col(i) - start) % every == 0)
    x = x.where(sampled("__i"))
    for votes in _votes(bars, sampled("i")):
        x = x.join(votes.withColumnRenamed("i", "__i"), ["symbol", "__i"], "left")
    c, m50, m150, m200 = (F.col(n) for n in ("close", "__a50", "__a150", "__a200"))
    sign = lambda s: F.when(s > I.FLAT, 1.0).when(s < -I.FLAT, -1.0).when(s.isNotNull(), 0.0)
    mtf = [sign(F.col(f"__s{b}")) for _, b in R.HORIZONS]
    crit = [
        (c > m150) & (c > m200), m150 > m200, m200 > F.col("__a200p"), (m50 > m150) & (m50 > m200), c > m50,
        c >= 1.30 * F.col("__lo"), c >= 0.75 * F.col("__hi"), F.coalesce("__rs", "__yr") > 0,
    ]
    score = sum((w.flag(k).cast("int") for k in crit), F.lit(0))
    base = (score - 4) / 4.0
    stage2 = (score >= 7) & crit[0] & crit[1] & crit[3] & crit[4]
    stage4 = (score <= 2) & (c < m200)
    half = lambda k: F.when(k, 0.5).otherwise(-0.5)
    r = F.col("rsi")
    cross = F.when(m50 > m200, "golden").when(m200.isNotNull(), "death")
    return x.select(
        *keep,
        F.col("__i").alias("i"),
        (sign(F.col("__sl")) * (0.5 + 0.5 * w.clip(F.col("__r2"), 0.0, 1.0))).alias("trend"),
        (sum(mtf[1:], mtf[0]) / float(len(mtf))).alias("multi_timeframe"),
        F.when(m200.isNotNull(), half(c > m200) + half(m50 > m200)).alias("regime"),
        F.when(r >= 70, -0.6).when(r <= 30, 0.6).otherwise((r - 50) / 40 * 0.4).alias("rsi"),
        F.when(F.col("__m") > F.col("__ms"), 0.6).otherwise(-0.6).alias("macd"),
        F.when(w.flag(stage2), F.greatest(base, F.lit(0.5))).when(w.flag(stage4), F.least(base, F.lit(-0.5))).otherwise(base).alias("template"),
        "candles",
        F.when(F.col("__vol") != 0, F.coalesce("volume_vote", F.lit(0.0))).alias("volume_vote"),
        "patterns",
        w.clip(F.col("__rs") / 0.20, -1.0, 1.0).alias("relative_strength"),
        *([r.alias("rsi_value"), cross.alias("cross"), (score == 8).alias("passes"), F.when(w.flag(stage2), 2).when(w.flag(stage4), 4).cast("long").alias("stage")] if facts else []),
    )


def _votes(bars: DataFrame, sampled: Column) -> list[DataFrame]:
    """Candle, volume and chart pattern votes of the sampled bars, each (symbol, i, value)."""
    b = bars.withColumn("i", w.bar_no())
    asked = b.where(sampled).select("symbol", "i")
    # Stored, as ordinals, outcomes and questions each read all events.
    hits = session.as_table(C.with_hits(b).select("symbol", "i", F.inline("hits")).drop("strength"), "candle_events")
    volume = VOL.all_events(bars).join(b.select("symbol", "ts", "i"), ["symbol", "ts"]).select("symbol", "i", "rank", "name", "bias")
    volume = session.as_table(volume, "volume_events")
    return [
        A.candle_votes(b.select("symbol", "ts", "i", "close"), hits, asked),
        A.volume_votes(volume, asked).withColumnRenamed("volume", "volume_vote"),
        AP.pattern_votes(b.select("symbol", "ts", "i", "close"), asked),
    ]


def scored_series(bars: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Posture per sampled bar whose longest forward return exists, with its components and forward returns."""
    f = S.forward(bars.select("symbol", "ts", "close"), HORIZONS).drop("close").where(F.col(f"fwd_{max(HORIZONS)}").isNotNull())
    p = posture_series(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), benchmark, **kw)
    p = p.drop("open", "high", "low", "close", "volume").withColumnRenamed("volume_vote", "volume")
    p = p.join(f, ["symbol", "ts"])
    s = CO.posture_score(p.select("*", *(F.col(n).alias(f"__{n}") for n in COMPONENTS)))
    return s.withColumnsRenamed({f"__{n}": n for n in COMPONENTS})


def component_correlations(scored: DataFrame) -> DataFrame:
    """Correlation of every component (absent ones count 0) and the score with each forward return."""
    names = [*COMPONENTS, "score"]
    x = scored.fillna(0.0, COMPONENTS)
    aggs = [stats.corr(n, f"fwd_{h}").alias(f"{n}__{h}") for n in names for h in HORIZONS]
    g = x.agg(*aggs)
    cells = [F.struct(F.lit(n).alias("component"), *[F.col(f"{n}__{h}").alias(f"corr_{h}") for h in HORIZONS]) for n in names]
    return g.select(F.inline(F.array(*cells)))


def returns_by_verdict(scored: DataFrame, h: int = 20) -> DataFrame:
    """Forward returns after each verdict and after all; the median by exact counts of distinct returns."""
    f = F.col(f"fwd_{h}")
    x = scored.where(f.isNotNull()).select(f.alias("fwd"), F.explode(F.array(F.col("verdict"), F.lit("ALL"))).alias("group"))
    g = x.groupBy("group").agg(F.count("fwd").alias("n"), F.avg("fwd").alias("mean_fwd"), stats.rate(F.col("fwd") > 0).alias("win_rate"))
    return g.join(ranks.exact_quantiles(x, ["group"], "fwd", {"median_fwd": 0.5}), "group")


def walkforward_verdicts(scored: DataFrame, lookback: int = 120, every: int = 8, horizons=(5, 20)) -> DataFrame:
    """Per symbol and horizon over its last sampled bars: mean return after each verdict, after all, and the score's correlation.

    ``scored`` holds every bar; of the newest ``lookback`` bars each ``every``-th one is taken."""
    last = Window.partitionBy("symbol")
    x = scored.withColumn("__first", F.greatest(F.min("i").over(last), F.max("i").over(last) + max(HORIZONS) + 1 - lookback))
    x = x.where((F.col("i") >= F.col("__first")) & ((F.col("i") - F.col("__first")) % every == 0))
    cells = [F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons]
    x = x.select("symbol", "verdict", "score", F.inline(F.array(*cells)))
    of = lambda v: [F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v.lower()}"), F.avg(F.when(F.col("verdict") == v, F.col("fwd"))).alias(f"mean_{v.lower()}")]
    n = F.count("fwd")
    return x.groupBy("symbol", "horizon").agg(
        n.alias("n"), *of("BUY"), *of("HOLD"), *of("SELL"), F.avg("fwd").alias("mean_all"), F.when(n > 2, stats.corr("score", "fwd")).alias("score_corr")
    )


def walkforward_logistic(scored: DataFrame, split: str, embargo_days: int = 28, h: int = 20) -> DataFrame:
    """A standardised logistic model of the up-move, trained before ``split``
    with an embargo and tested from it: accuracy, base rate and the correlation
    of its probability and of the score with the return."""
    cut = F.lit(split).cast("timestamp")
    x = scored.where(F.col(f"fwd_{h}").isNotNull()).fillna(0.0, COMPONENTS)
    x = x.withColumn("label", (F.col(f"fwd_{h}") > 0).cast("double"))
    x = VectorAssembler(inputCols=COMPONENTS, outputCol="raw").transform(x)
    train = x.where(F.col("ts") < cut - F.expr(f"INTERVAL {embargo_days} DAYS"))
    test = x.where(F.col("ts") >= cut)
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    lr = LogisticRegression(maxIter=100, regParam=0.01).fit(sc.transform(train))
    p = lr.transform(sc.transform(test)).withColumn("p", vector_to_array("probability")[1])
    up = F.avg("label")
    return p.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.greatest(up, 1 - up).alias("base_rate"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        stats.corr("p", f"fwd_{h}").alias("prob_corr"),
        stats.corr("score", f"fwd_{h}").alias("score_corr"),
    )
