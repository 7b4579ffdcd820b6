"""Causal per-symbol indicators.  Each function adds columns to a bar frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import windows as w

FLAT = 0.05  # % per bar


def sma(c: str | Column, n: int, shift: int = 0) -> Column:
    return w.roll(F.avg, c, n, shift)


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, c: str = "close") -> DataFrame:
    mid, sd = sma(c, n), w.roll(F.stddev_samp, c, n)
    return df.withColumns({"bb_mid": mid, "bb_upper": mid + F.lit(k) * sd, "bb_lower": mid - F.lit(k) * sd})


def _rsi_value(gain: Column, loss: Column, rules: bool) -> Column:
    plain = 100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss))
    if not rules:
        return F.when(loss != 0, plain)
    return (
        F.when(gain.isNull() | loss.isNull(), F.lit(None).cast("double"))
        .when((gain == 0) & (loss == 0), F.lit(50.0))
        .when(gain == 0, F.lit(0.0))
        .when(loss == 0, F.lit(100.0))
        .otherwise(plain)
    )


def rsi(df: DataFrame, out: str = "rsi", period: int = 14, method: str = "wilder", c: str = "close") -> DataFrame:
    """Relative strength index in its four published forms.

    ``wilder``  recursive means, NULL for the first ``period`` changes' warm-up,
                explicit limits 100 / 0 / 50
    ``ewm``     recursive means from the first change, NULL without losses
    ``sma``     simple means over full windows, NULL without losses
    """
    diff = F.col(c) - w.lag(c)
    df = df.withColumn("__g", F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0)))).withColumn(
        "__l", F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0)))
    )
    if method == "sma":
        value = _rsi_value(sma("__g", period), sma("__l", period), rules=False)
        return df.withColumn(out, value).drop("__g", "__l")
    a = 1.0 / period
    df = scan.ewm(df, {"__ag": ("__g", a), "__al": ("__l", a)})
    gain, loss = F.col("__ag"), F.col("__al")
    if method == "wilder":
        ready = F.count("__g").over(w.history()) >= period
        value = F.when(ready, _rsi_value(gain, loss, rules=True))
    elif method == "ewm":
        value = _rsi_value(gain, loss, rules=False)
    else:
        raise ValueError(f"unknown RSI method {method}")
    return df.withColumn(out, value).drop("__g", "__l", "__ag", "__al")


def macd(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, c: str = "close", prefix: str = "macd"
) -> DataFrame:
    """MACD line, its signal EMA and the histogram."""
    df = scan.ema(df, {"__f": (c, fast), "__s": (c, slow)}).withColumn(prefix, F.col("__f") - F.col("__s"))
    df = scan.ema(df, {f"{prefix}_signal": (prefix, signal)})
    return df.withColumn(f"{prefix}_hist", F.col(prefix) - F.col(f"{prefix}_signal")).drop("__f", "__s")


def compute_all(df: DataFrame) -> DataFrame:
    """SMA20/50, EMA12/26, Wilder RSI, the MACD trio and the Bollinger trio."""
    df = df.withColumns({"sma20": sma("close", 20), "sma50": sma("close", 50)})
    df = bollinger(df)
    df = rsi(df)
    df = scan.ema(df, {"ema12": ("close", 12), "ema26": ("close", 26)})
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = scan.ema(df, {"macd_signal": ("macd", 9)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def latest_snapshot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Last non-null value of each column per symbol."""
    return df.groupBy("symbol").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns]
    )


def true_range() -> Column:
    prev = w.lag("close")
    hl = F.col("high") - F.col("low")
    return F.greatest(hl, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(df: DataFrame, period: int = 14, out: str = "atr") -> DataFrame:
    """Simple mean of the true range; the first bar's range is high - low."""
    return (
        df.withColumn("__tr", true_range())
        .withColumn(out, w.roll(F.avg, "__tr", period))
        .drop("__tr")
    )


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    """Running sum of sign(change) * volume, a missing volume counts 0."""
    step = F.signum(F.coalesce(F.col("close") - w.lag("close"), F.lit(0.0))) * F.coalesce("volume", F.lit(0.0))
    return df.withColumn("__s", step).withColumn(out, F.sum("__s").over(w.history())).drop("__s")


def label_sign(x: Column, limit: float, up: str, down: str, flat: str) -> Column:
    return F.when(x > limit, F.lit(up)).when(x < -limit, F.lit(down)).otherwise(F.lit(flat))


def obv_trend(df: DataFrame, n: int = 20) -> DataFrame:
    """Slope of the last ``n`` OBV values over their mean size, per symbol."""
    tail = obv(df).withColumn("__a", w.bars_ago()).where(F.col("__a") < n)
    g = tail.groupBy("symbol").agg(
        F.regr_slope("obv", -F.col("__a").cast("double")).alias("__slope"),
        F.avg(F.abs("obv")).alias("__scale"),
    )
    norm = w.ratio("__slope", F.when(F.col("__scale") == 0, F.lit(1.0)).otherwise(F.col("__scale")))
    return g.select("symbol", norm.alias("obv_slope"), label_sign(norm, 0.01, "rising", "falling", "flat").alias("obv_trend"))


def volume_ratio(n: int = 50, min_periods: int | None = None) -> Column:
    """Volume over its trailing mean (the current bar included)."""
    return w.ratio("volume", w.roll(F.avg, "volume", n, 0, min_periods))


def lin_trend(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least-squares line through the closes of each group: slope in % per bar,
    R2, fitted ends and direction."""
    keys = keys or ["symbol"]
    g = (
        df.withColumn("__x", w.bar_no(keys).cast("double"))
        .groupBy(*keys)
        .agg(
            F.count("close").alias("bars"),
            F.regr_slope("close", "__x").alias("__b"),
            F.regr_intercept("close", "__x").alias("__a"),
            F.regr_r2("close", "__x").alias("__r2"),
            F.avg("close").alias("__m"),
        )
    )
    slope = F.coalesce(w.ratio(F.col("__b") * 100.0, "__m"), F.lit(0.0))
    return g.select(
        *keys,
        "bars",
        slope.alias("slope_pct_per_bar"),
        F.coalesce("__r2", F.lit(0.0)).alias("r2"),
        F.coalesce("__a", "__m").alias("fit_start"),
        F.coalesce(F.col("__a") + F.col("__b") * (F.col("bars") - 1), F.col("__m")).alias("fit_end"),
        label_sign(slope, FLAT, "uptrend", "downtrend", "sideways").alias("direction"),
    )


def pct_rank_of_latest(df: DataFrame, c: str, n: int = 504, need: int = 100) -> DataFrame:
    """Share (0-100) of the last ``n`` bars' values at or below the newest one."""
    tail = df.withColumn("__a", w.bars_ago()).where(F.col("__a") < n)
    tail = tail.withColumn("__now", F.max(F.when(F.col("__a") == 0, F.col(c))).over(w.whole()))
    share = F.avg(F.when(F.col(c).isNotNull(), (F.col(c) <= F.col("__now")).cast("double"))) * 100.0
    return tail.groupBy("symbol").agg(F.when(F.count(c) > need, share).alias("pct_rank"))


def cross_up(a: Column, b: Column) -> Column:
    """True on the first bar with a > b after a <= b."""
    above = w.flag(a > b)
    return above & ~F.coalesce(w.lag(above), F.lit(False))


def recent_cross(df: DataFrame, a: str, b: str | None, lookback: int = 90, out: str = "cross") -> DataFrame:
    """Latest sign change of a - b within ``lookback`` bars per symbol; bars
    where either side is exactly zero do not count."""
    s = F.signum(F.col(a) - (F.col(b) if b else F.lit(0.0)))
    x = df.withColumn("__s", s).withColumn("__p", w.lag("__s")).withColumn("__a", w.bars_ago())
    hit = (F.col("__s") != 0) & (F.col("__p") != 0) & (F.col("__s") != F.col("__p")) & (F.col("__a") < lookback)
    g = x.groupBy("symbol").agg(
        F.min_by("__s", F.when(hit, F.col("__a"))).alias("__d"),
        F.min(F.when(hit, F.col("__a"))).alias("__n"),
        F.max(F.when(hit, F.col("ts"))).alias("__t"),
    )
    return g.select(
        "symbol",
        F.when(F.col("__n").isNotNull(), F.when(F.col("__d") > 0, "up").otherwise("down")).alias(f"{out}_dir"),
        F.col("__n").alias(f"{out}_bars_ago"),
        F.col("__t").alias(f"{out}_ts"),
    )


def round_step(price: Column) -> Column:
    return F.when(price < 20, 1.0).when(price < 100, 5.0).when(price < 500, 10.0).when(price >= 500, 50.0)


def round_level(price: Column) -> Column:
    """Next multiple of the price-scaled step strictly above ``price``."""
    step = round_step(price)
    return F.floor(price / step).cast("double") * step + step


def base_range(n: int, shift: int = 0, c: str = "close") -> Column:
    """(max - min) / close over ``n`` bars, the tightness of a base."""
    hi, lo = w.roll(F.max, c, n), w.roll(F.min, c, n)
    tight = w.ratio(hi - lo, c)
    return w.lag(tight, shift) if shift else tight


def cum_return(r: str | Column) -> Column:
    """Compounded growth of simple returns: exp of summed logs, a return of
    -100% or worse pins the product at 0."""
    return compounded(F.coalesce(w.col(r), F.lit(0.0)), w.history())


def compounded(r: Column, spec: WindowSpec) -> Column:
    """The product of ``1 + r`` over a window; a total loss leaves 0 for good."""
    dead = F.max((r <= -1.0).cast("int")).over(spec)
    grown = F.exp(F.sum(F.log1p(F.when(r > -1.0, r).otherwise(0.0))).over(spec))
    return F.when(dead == 1, F.lit(0.0)).otherwise(grown)
