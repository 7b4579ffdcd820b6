"""Per-symbol regime reads on the newest bar.

A bar knows its age (0 = newest), so every trailing mean or extreme is one
conditional aggregate: the whole read is a single hash aggregation behind the
symbol exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from . import indicators as I
from . import joins

# fixed values: horizon labels and their bar counts
HORIZONS = [("1W", 5), ("1M", 21), ("3M", 63), ("6M", 126), ("1Y", 252)]
TEMPLATE_MIN = 252
TEMPLATE_LAG = 22
RS_LOOKBACK = 126
AGE = "__age"


def aged(df: DataFrame) -> DataFrame:
    return df.withColumn(AGE, w.bars_ago())


def within(first: int, last: int, c: str | Column = "close") -> Column:
    """The column's value on bars aged ``first`` .. ``last``, NULL elsewhere."""
    return F.when(F.col(AGE).between(first, last), w.col(c))


def at(age: int, c: str | Column = "close") -> Column:
    return F.max(within(age, age, c))


def tail(agg: Callable[[Column], Column], n: int, c: str | Column = "close", shift: int = 0) -> Column:
    """Aggregate over ``n`` bars ending ``shift`` bars ago; NULL on a short history."""
    v = within(shift, shift + n - 1, c)
    return F.when(F.count(v) >= n, agg(v))


def multi_timeframe(df: DataFrame) -> DataFrame:
    """(symbol, label, bars, change, slope_pct_per_bar, direction), one row per
    horizon the history covers."""
    x = aged(df)
    aggs = []
    for label, b in HORIZONS:
        y = within(0, b)
        pos = F.when(F.col(AGE) <= b, -F.col(AGE).cast("double"))
        slope = w.ratio(F.regr_slope(y, pos) * 100.0, F.avg(y))
        aggs.append(
            F.when(
                F.count(y) >= b + 1,
                F.struct(
                    F.lit(label).alias("label"),
                    F.lit(b).cast("long").alias("bars"),
                    (w.ratio(at(0), at(b)) - 1.0).alias("change"),
                    slope.alias("slope_pct_per_bar"),
                    I.label_sign(slope, I.FLAT, "uptrend", "downtrend", "sideways").alias("direction"),
                ),
            ).alias(f"h{b}")
        )
    g = x.groupBy("symbol").agg(*aggs)
    rows = F.filter(F.array(*[f"h{b}" for _, b in HORIZONS]), lambda s: s.isNotNull())
    return g.select("symbol", F.inline(rows))


def alignment(frames: DataFrame) -> DataFrame:
    """How far the horizons agree, per symbol."""
    g = frames.groupBy("symbol").agg(
        F.count(F.when(F.col("direction") == "uptrend", 1)).alias("ups"),
        F.count(F.when(F.col("direction") == "downtrend", 1)).alias("downs"),
        F.count(F.lit(1)).alias("horizons"),
    )
    u, d, n = F.col("ups"), F.col("downs"), F.col("horizons")
    return g.withColumn(
        "alignment",
        F.when(u == n, "strong_up").when(d == n, "strong_down").when(u > d, "mostly_up").when(d > u, "mostly_down").otherwise("mixed"),
    )


def ma_regime(df: DataFrame) -> DataFrame:
    """Price against its 50 and 200-bar means and the golden / death cross."""
    g = aged(df).groupBy("symbol").agg(
        F.max("ts").alias("ts"),
        at(0).alias("price"),
        tail(F.avg, 50).alias("sma50"),
        tail(F.avg, 200).alias("sma200"),
    )
    return g.withColumns(
        {
            "above_sma50": F.col("price") > F.col("sma50"),
            "above_sma200": F.col("price") > F.col("sma200"),
            "cross": F.when(F.col("sma50") > F.col("sma200"), "golden").when(
                F.col("sma200").isNotNull(), "death"
            ),
        }
    )


def relative_strength(df: DataFrame, benchmark: DataFrame, lookback: int = RS_LOOKBACK) -> DataFrame:
    """Return over ``lookback - 1`` bars minus the benchmark's as-of return."""
    x = aged(joins.with_benchmark(df, benchmark))
    g = x.groupBy("symbol").agg(
        F.count(within(0, lookback)).alias("__n"),
        F.count(within(0, lookback, "bench")).alias("__nb"),
        (w.ratio(at(0), at(lookback - 1)) - 1.0).alias("stock_ret"),
        (w.ratio(at(0, "bench"), at(lookback - 1, "bench")) - 1.0).alias("bench_ret"),
    )
    g = g.where((F.col("__n") == lookback + 1) & (F.col("__nb") == lookback + 1))
    excess = F.col("stock_ret") - F.col("bench_ret")
    return g.where(excess.isNotNull()).select(
        "symbol",
        "stock_ret",
        "bench_ret",
        excess.alias("excess"),
        (excess > 0).alias("outperforming"),
        w.clip(excess / 0.20, -1.0, 1.0).alias("value"),
    )


def trend_template(df: DataFrame, rs: DataFrame | None = None) -> DataFrame:
    """Eight criteria, their score and the stage; unavailable below one year."""
    g = aged(df).groupBy("symbol").agg(
        F.count("close").alias("bars"),
        at(0).alias("price"),
        tail(F.avg, 50).alias("sma50"),
        tail(F.avg, 150).alias("sma150"),
        tail(F.avg, 200).alias("sma200"),
        tail(F.avg, 200, shift=TEMPLATE_LAG).alias("sma200_prior"),
        tail(F.min, TEMPLATE_MIN).alias("low_52w"),
        tail(F.max, TEMPLATE_MIN).alias("high_52w"),
        (w.ratio(at(0), at(TEMPLATE_MIN - 1)) - 1.0).alias("year_return"),
    )
    strength = F.col("year_return")
    if rs is not None:
        g = g.join(rs.select("symbol", F.col("excess").alias("rs_excess")), "symbol", "left")
        strength = F.coalesce("rs_excess", "year_return")
    p, m50, m150, m200 = (F.col(c) for c in ("price", "sma50", "sma150", "sma200"))
    crit = {
        "c1": (p > m150) & (p > m200),
        "c2": m150 > m200,
        "c3": m200 > F.col("sma200_prior"),
        "c4": (m50 > m150) & (m50 > m200),
        "c5": p > m50,
        "c6": p >= 1.30 * F.col("low_52w"),
        "c7": p >= 0.75 * F.col("high_52w"),
        "c8": strength > 0,
    }
    g = g.withColumn("available", F.col("bars") >= TEMPLATE_MIN)
    g = g.withColumns({k: F.when(F.col("available"), w.flag(c)) for k, c in crit.items()})
    score = sum((F.coalesce(F.col(k), F.lit(False)).cast("long") for k in crit), F.lit(0).cast("long"))
    g = g.withColumn("score", score)
    return g.select(
        "symbol",
        "available",
        *crit,
        "score",
        (F.col("score") == 8).alias("passes"),
        F.when(F.col("available"), weinstein_stage()).alias("stage"),
    )


def weinstein_stage() -> Column:
    """Stage 1-4 from the score and the means."""
    below = F.col("price") < F.col("sma200")
    return (
        F.when((F.col("score") >= 7) & F.col("c1") & F.col("c2") & F.col("c4") & F.col("c5"), 2)
        .when((F.col("score") <= 2) & below, 4)
        .when(below & (F.col("sma50") > F.col("sma150")), 1)
        .otherwise(3)
        .cast("long")
    )


def trend_stage(df: DataFrame) -> DataFrame:
    """Uptrend / topping / recovering / declining / basing by the slope of the
    200-bar mean over 21 bars (flat within half a percent)."""
    g = aged(df).groupBy("symbol").agg(
        at(0).alias("price"),
        tail(F.avg, 50).alias("sma50"),
        tail(F.avg, 200).alias("sma200"),
        (w.ratio(tail(F.avg, 200), tail(F.avg, 200, shift=21)) - 1.0).alias("slope200"),
    )
    p = F.col("price")
    return g.where(F.col("slope200").isNotNull()).withColumn(
        "stage",
        F.when((p > F.col("sma200")) & (F.col("slope200") > 0.005), "stage2")
        .when(p > F.col("sma200"), "stage3")
        .when(p > F.col("sma50"), "recovering")
        .when(F.col("slope200") < -0.005, "stage4")
        .otherwise("stage1"),
    )


def extension_state(df: DataFrame, ma: int = 50, extended: float = 0.15, blowoff: float = 0.25, near: float = 0.02) -> DataFrame:
    """Stretch of the price over its mean, its percentile in two years and state."""
    x = aged(df.withColumn("__ext", w.ret("close", I.sma("close", ma))))
    x = x.withColumn("__now", F.max(within(0, 0, "__ext")).over(w.whole()))
    last2y = within(0, 503, "__ext")
    g = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        at(0, "__ext").alias("ext"),
        F.when(F.count(last2y) > 100, F.avg((last2y <= F.col("__now")).cast("double")) * 100.0).alias("percentile_2y"),
        F.max(within(0, 62, "__ext")).alias("recent_max_ext"),
    )
    e = F.col("ext")
    return (
        g.where((F.col("__n") >= ma + 70) & e.isNotNull())
        .withColumn(
            "state",
            F.when(e >= blowoff, "blowoff")
            .when(e >= extended, "extended")
            .when((F.abs(e) <= near) & (F.col("recent_max_ext") >= extended), "ma_touch_after_run")
            .when(e <= -extended, "stretched_below")
            .otherwise("normal"),
        )
        .drop("__n")
    )


MIN_GAP = 0.005
BIG_GAP = 0.02
GAP_MIN_N = 10


def with_gaps(df: DataFrame) -> DataFrame:
    """Bars with the opening gap, its direction and size bucket, and whether the
    day continued the gap or traded back to the prior close."""
    pc = w.lag("close")
    x = df.withColumns({"prev_close": pc, "gap": w.ret("open", pc), "o2c": w.ret("close", "open")})
    up, down = F.col("gap") >= MIN_GAP, F.col("gap") <= -MIN_GAP
    return x.withColumns(
        {
            "direction": F.when(up, "up").when(down, "down"),
            "size": F.when(F.abs("gap") >= BIG_GAP, "big").otherwise("small"),
            "continued": F.when(up, F.col("close") > F.col("open")).when(down, F.col("close") < F.col("open")),
            "faded": F.when(up, F.col("low") <= F.col("prev_close")).when(down, F.col("high") >= F.col("prev_close")),
        }
    )


def gap_stats(df: DataFrame, min_n: int = GAP_MIN_N) -> DataFrame:
    """Own gap record per direction and size (small, big, all), newest bar excluded."""
    x = aged(with_gaps(df)).where((F.col(AGE) >= 1) & F.col("direction").isNotNull())
    rows = x.withColumn("bucket", F.explode(F.array(F.col("size"), F.lit("all"))))
    g = rows.groupBy("symbol", "direction", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("continued").cast("double")).alias("continued_rate"),
        F.avg(F.col("faded").cast("double")).alias("faded_rate"),
        F.avg("o2c").alias("avg_open_to_close"),
    )
    return g.where(F.col("n") >= min_n)


def gap_today(df: DataFrame, min_bars: int = 121) -> DataFrame:
    """The newest bar's gap with the symbol's own matching rates; the ``all``
    bucket stands in when the sized one is too thin."""
    s = gap_stats(df)
    x = aged(with_gaps(df))
    now = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        at(0, "gap").alias("gap"),
        F.max(within(0, 0, "direction")).alias("direction"),
        F.max(within(0, 0, "size")).alias("size"),
    )
    now = now.where(F.col("__n") >= min_bars).join(s.select("symbol").distinct(), "symbol", "left_semi")
    cols = ["n", "continued_rate", "faded_rate", "avg_open_to_close"]

    def rates(prefix: str) -> DataFrame:
        return s.select("symbol", "direction", "bucket", F.struct(*cols).alias(prefix))

    sized = rates("__s").withColumnRenamed("bucket", "size")
    every = rates("__e").where(F.col("bucket") == "all").drop("bucket")
    out = now.join(sized, ["symbol", "direction", "size"], "left").join(every, ["symbol", "direction"], "left")
    pick = F.coalesce("__s", "__e")
    return out.select(
        "symbol",
        "gap",
        F.col("direction").isNotNull().alias("gapped_today"),
        "direction",
        F.when(F.col("direction").isNotNull(), F.col("size")).alias("bucket"),
        *[pick[c].alias(c) for c in cols],
    )


def breakout_watch(df: DataFrame, rsi: bool = True) -> DataFrame:
    """A 25-bar base ending six bars ago: broke above it or coils under it."""
    x = aged(I.rsi(df))
    base = within(6, 30)
    g = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        F.count(base).alias("__nb"),
        at(0).alias("price"),
        at(1).alias("__c1"),
        at(5).alias("__c5"),
        F.max(base).alias("level"),
        F.min(base).alias("__lo"),
        at(0, "rsi").alias("rsi"),
        tail(F.avg, 200).alias("sma200"),
    )
    p, r = F.col("price"), F.col("level")
    ranged = w.ratio(r - F.col("__lo"), r) <= 0.15
    broke = ranged & (p > r) & (F.col("__c5") <= r)
    coil = ranged & (p <= r) & (w.ratio(r - p, r) <= 0.04)
    return (
        g.where((F.col("__nb") >= 20) & (F.col("__n") >= 210) & (broke | coil))
        .select(
            "symbol",
            "level",
            F.when(broke, "broke").otherwise("coiling").alias("status"),
            (broke & (F.col("__c1") <= r)).alias("fresh"),
            (w.ratio(p, r) - 1.0).alias("dist"),
            w.flag(F.col("rsi") >= 68).alias("overbought"),
            (F.col("sma200") > p).alias("overhead_200"),
            (w.ratio(p, "sma200") - 1.0).alias("dist_200"),
        )
    )


def crossover_system(df: DataFrame, contrarian: bool = False) -> DataFrame:
    """EMA 55/89/204 stack, MACD 13/34/9 and price: buy, sell or neutral, the
    conditions met and the latest of four crossing events."""
    from ..functions import scan

    x = scan.ema(df, {"e55": ("close", 55), "e89": ("close", 89), "e204": ("close", 204)})
    x = I.macd(x, 13, 34, 9)
    pairs = {"macro": ("e89", "e204"), "fast": ("e55", "e89"), "zero": ("macd", None), "signal": ("macd", "macd_signal")}
    for name, (a, b) in pairs.items():
        s = F.signum(F.col(a) - (F.col(b) if b else F.lit(0.0)))
        x = x.withColumn(f"__s_{name}", s).withColumn(f"__p_{name}", w.lag(f"__s_{name}"))
    x = aged(x)
    aggs = []
    for name in pairs:
        s, p = F.col(f"__s_{name}"), F.col(f"__p_{name}")
        age = F.when((s != 0) & (p != 0) & (s != p) & (F.col(AGE) < 90), F.col(AGE))
        aggs += [F.min(age).alias(f"{name}_bars_ago"), F.min_by(s, age).alias(f"__d_{name}")]
    g = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        *[at(0, c).alias(a) for c, a in (("close", "price"), ("e55", "e55"), ("e89", "e89"), ("e204", "e204"), ("macd", "macd"), ("macd_signal", "macd_signal"))],
        *aggs,
    ).where(F.col("__n") >= 209)
    p, f_, m_, s_ = (F.col(c) for c in ("price", "e55", "e89", "e204"))
    bull, bear = (f_ > m_) & (m_ > s_), (f_ < m_) & (m_ < s_)
    above0, abovef = F.col("macd") > 0, p > f_
    buy, sell = bull & above0 & abovef, bear & ~above0 & ~abovef
    if contrarian:
        buy, sell = sell, buy
    return g.select(
        "symbol",
        "price",
        "e55",
        "e89",
        "e204",
        "macd",
        "macd_signal",
        F.when(buy, "buy").when(sell, "sell").otherwise("neutral").alias("state"),
        F.when(buy, "up").when(sell, "down").alias("direction"),
        (bull.cast("long") + above0.cast("long") + abovef.cast("long")).alias("conditions_met"),
        *[c for n in pairs for c in (
            F.when(F.col(f"__d_{n}") > 0, "up").when(F.col(f"__d_{n}") < 0, "down").alias(f"{n}_cross"),
            F.col(f"{n}_bars_ago"),
        )],
    )
