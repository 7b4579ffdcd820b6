"""Point-in-time features and the boolean signal masks built on them.

A mask is a Column over the feature frame.  ``register`` adds a user's own;
every study runs any set of masks in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from . import indicators as I
from . import joins

CRASH = 0.20
CRASH_WINDOW = 63
BIG_CRASH = 0.40
MATURE = 400
NEW_HIGH = 21
LEVEL = 50

Mask = Callable[[], Column]
MASKS: dict[str, Mask] = {}


def register(name: str, build: Mask) -> None:
    """Plug in a named mask; it must be a pure column expression."""
    MASKS[name] = build


def columns(names: list[str]) -> dict[str, Column]:
    return {n: w.flag(MASKS[n]()) for n in names}


def with_features(df: DataFrame) -> DataFrame:
    """All rolling features in three window layers over one shuffle and sort."""
    c = F.col("close")
    df = df.withColumns(
        {
            **{f"sma{n}": I.sma("close", n) for n in (5, 20, 50, 150, 200)},
            "hi252": w.roll(F.max, "close", 252),
            "lo60": w.roll(F.min, "close", 60),
            "max20": w.roll(F.max, "close", 20),
            "min20": w.roll(F.min, "close", 20),
            "roll21": w.roll(F.max, "close", 21),
            **{f"prior{n}": w.roll(F.max, "close", n, 1) for n in (20, 21, 50, 252)},
            "prior_high50": w.roll(F.max, "high", LEVEL, 1),
            "volavg50": w.roll(F.avg, "volume", 50),
            "history": F.count("close").over(w.trailing(MATURE)),
            "prev": w.lag("close"),
            "mom6": w.ret("close", w.lag("close", 126)),
            "mom12_1": w.ret(w.lag("close", 21), w.lag("close", 252)),
        }
    )
    df = df.withColumns(
        {
            "dd": w.ret("close", "hi252"),
            "below200": w.flag(c < F.col("sma200")),
            "above50": w.flag(c > F.col("sma50")),
            "enough": F.col("history") >= MATURE,
            "vr": w.ratio("volume", "volavg50"),
            "new21": w.flag(c > F.col("prior21")),
            "above_level": w.flag(c > F.col("prior_high50")),
            "tight": w.ratio(F.col("max20") - F.col("min20"), c),
        }
    )
    return df.withColumns(
        {
            "dd_min": w.roll(F.min, "dd", CRASH_WINDOW),
            "above50_before": F.coalesce(w.lag("above50"), F.lit(False)),
            "above_level_before": F.coalesce(w.lag("above_level"), F.lit(False)),
            "sma200_before": w.lag("sma200"),
            "sma50_20": w.lag("sma50", 20),
            "sma200_21": w.lag("sma200", 21),
            "sma200_22": w.lag("sma200", 22),
            "sma200_252": w.lag("sma200", 252),
            "tight_before": w.lag("tight"),
            "breaks21": w.roll(F.sum, F.col("new21").cast("int"), 21, 1),
            "breaks10": F.max(F.col("new21").cast("int")).over(w.trailing(10)),
            "old_level": w.lag("roll21", 11),
        }
    )


def with_rsi(df: DataFrame) -> DataFrame:
    """RSI columns the oscillator masks read: recursive 2 and 14, simple 2 and 14."""
    df = I.rsi(df, "rsi2", 2, "ewm")
    df = I.rsi(df, "rsi14", 14, "ewm")
    df = I.rsi(df, "rsi2_sma", 2, "sma")
    return I.rsi(df, "rsi14_sma", 14, "sma")


def with_relative(df: DataFrame, benchmark: DataFrame, n: int = 126) -> DataFrame:
    """``rs``: n-bar return minus the benchmark's over the same bars, and its
    average-tie percentile rank among the symbols of a date."""
    df = joins.with_benchmark(df, benchmark)
    df = df.withColumn("rs", w.ret("close", w.lag("close", n)) - w.ret("bench", w.lag("bench", n)))
    return df.withColumn("rs_rank", pct_rank("rs"))


def pct_rank(c: str, keys: str = "ts") -> Column:
    """Average rank of ties over the count of non-null values, per date."""
    from pyspark.sql import Window

    v = F.col(c)
    spec = Window.partitionBy(keys, v.isNull()).orderBy(v)
    ties = F.count(F.lit(1)).over(Window.partitionBy(keys, v))
    n = F.count(v).over(Window.partitionBy(keys, v.isNull()))
    return F.when(v.isNotNull(), (F.rank().over(spec) + (ties - 1) / 2.0) / n)


def _c(name: str) -> Column:
    return F.col(name)


def _crash() -> Column:
    return (_c("dd_min") <= -CRASH) & _c("enough")


def _cross50() -> Column:
    return _c("above50") & ~_c("above50_before")


def _reclaim200() -> Column:
    return (_c("close") > _c("sma200")) & (_c("prev") <= _c("sma200_before"))


def _recovering() -> Column:
    return _c("below200") & _c("above50")


def _fresh() -> Column:
    return _c("new21") & (_c("breaks21") == 0) & _c("enough")


def _flat_up() -> Column:
    return _c("sma200") >= _c("sma200_21") * 0.995


def _big_crash() -> Column:
    return (_c("dd_min") <= -BIG_CRASH) & _c("enough")


def _volbreak(x: float) -> Column:
    return (_c("close") > _c("prior50")) & (_c("vr") > x) & _c("enough")


MASKS.update(
    {
        "ALL": lambda: F.lit(True),
        "R1_reclaim50": lambda: _c("below200") & _cross50() & _crash(),
        "R2_recovering_state": lambda: _recovering() & _crash(),
        "R3_reclaim200": lambda: _reclaim200() & _crash(),
        "R4_bounce_low": lambda: _c("below200") & (w.ret("close", "lo60") >= 0.10) & _crash(),
        "R5_slope50_up": lambda: _c("below200") & (_c("sma50") > _c("sma50_20")) & _crash(),
        "STILL_WEAK": lambda: _c("below200") & ~_c("above50") & _crash(),
        "V1_recover_LTuptrend": lambda: _recovering() & _crash() & (_c("sma200") > _c("sma200_252")),
        "V2_bigDD_reclaim50": lambda: _big_crash() & _c("below200") & _cross50(),
        "V3_recover_RSI2_oversold": lambda: _recovering() & _crash() & (_c("rsi2_sma") < 15),
        "V4_reclaim200_slopeup": lambda: _reclaim200() & _crash() & (_c("sma200") > _c("sma200_21")),
        "V4b_reclaim200_slopeflat": lambda: _reclaim200() & _crash() & _flat_up(),
        "V5_recover_slopeflat": lambda: _recovering() & _crash() & _flat_up(),
        "V6_bigDD_recover": lambda: _big_crash() & _recovering(),
        "V7_wk200up_recover": lambda: _c("above_wk40") & _c("above50") & _crash(),
        "new20": lambda: _c("close") > _c("prior20"),
        "new50": lambda: _c("close") > _c("prior50"),
        "new252": lambda: _c("close") > _c("prior252"),
        "GEN_break": lambda: _c("new21") & _c("enough"),
        "B1_fresh_from_base": _fresh,
        "B2_retest": lambda: (_c("breaks10") == 1)
        & (F.abs(w.ret("close", "old_level")) < 0.02)
        & (_c("close") > _c("old_level"))
        & _c("enough"),
        "V0_plain50": lambda: (_c("close") > _c("prior50")) & _c("enough"),
        "V1_vol50_1.5x": lambda: _volbreak(1.5),
        "V2_vol50_2x": lambda: _volbreak(2.0),
        "V3_vol_uptrend": lambda: _volbreak(1.5) & (_c("close") > _c("sma200")),
        "V4_52whigh_vol": lambda: (_c("close") > _c("prior252")) & (_c("vr") > 1.5) & _c("enough"),
        "V5_vcp": lambda: _volbreak(1.5) & (_c("tight_before") < 0.10),
        "fresh_cross": lambda: _c("above_level") & ~_c("above_level_before"),
        "above_state": lambda: _c("above_level"),
        "dip_buy": lambda: (_c("rsi2") < 15) & (_c("close") > _c("sma200")) & _c("enough"),
        "overbought_break": lambda: _fresh() & (_c("rsi14_sma") > 68),
        "calm_break": lambda: _fresh() & (_c("rsi14_sma") <= 68),
        "overbought_RSI70": lambda: _c("rsi14") > 70,
        "extended_10pct": lambda: _c("close") > 1.10 * _c("sma50"),
        "below_200": lambda: _c("close") < _c("sma200"),
        "M1_tsmom_above200": lambda: (_c("close") > _c("sma200")) & (_c("mom12_1") > 0) & _c("enough"),
        "M3_golden_cross": lambda: (_c("sma50") > _c("sma200")) & _c("enough"),
        "M5_stage2_uptrend": lambda: (_c("close") > _c("sma50"))
        & (_c("sma50") > _c("sma200"))
        & (_c("sma50") > _c("sma50_20"))
        & _c("enough"),
        "trend_template": lambda: (_c("close") > _c("sma150"))
        & (_c("close") > _c("sma200"))
        & (_c("sma150") > _c("sma200"))
        & (_c("sma50") > _c("sma150"))
        & (_c("sma200") > _c("sma200_22"))
        & (_c("rs") > 0),
        "golden_cross": lambda: _c("sma50") > _c("sma200"),
        "oversold_in_uptrend": lambda: (_c("close") > _c("sma200")) & (_c("rsi14") < 40),
        "top_relative_strength": lambda: _c("rs_rank") >= 0.75,
    }
)


def with_weekly_trend(df: DataFrame, weeks: int = 40) -> DataFrame:
    """``above_wk40``: the last finished week closed above its 40-week mean and
    the bar closes above that mean, both as known one bar earlier."""
    from ..sources import bars as B

    wk = B.resample_last(df).withColumnRenamed("week_end", "ts")
    wk = wk.withColumn("wk_sma", w.roll(F.avg, "close", weeks)).select(
        "symbol", "ts", "wk_sma", w.flag(F.col("close") > F.col("wk_sma")).alias("wk_up")
    )
    x = joins.asof_backward(df.select("symbol", "ts", "close"), wk, ["symbol"], ["wk_sma", "wk_up"], unit="year")
    x = x.select(
        "symbol",
        "ts",
        (F.coalesce(w.lag("wk_up"), F.lit(False)) & w.flag(F.col("close") > w.lag("wk_sma"))).alias("above_wk40"),
    )
    return df.join(x, ["symbol", "ts"])
