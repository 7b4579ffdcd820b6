"""Volume signals and the per-symbol volume read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from . import candles, indicators

LOOKBACK = 40
MAX_SIGNALS = 10
SPIKE = 2.0
CONFIRM = 1.5
DRY = 0.5


def _base(df: DataFrame) -> DataFrame:
    df = df.withColumn("__v", F.coalesce("volume", F.lit(0.0)))
    return df.withColumns(
        {
            "__a50": w.roll(F.avg, "__v", 50, 0, 20),
            "__a5": w.roll(F.avg, "__v", 5, 0, 3),
            "__hi": w.roll(F.max, "close", 20),
            "__lo": w.roll(F.min, "close", 20),
            "__up": F.coalesce(F.col("close") > w.lag("close"), F.lit(False)),
        }
    ).withColumn("vol_ratio", F.when(F.col("__a50") > 0, F.col("__v") / F.col("__a50")))


def all_events(df: DataFrame, lookback: int | None = None) -> DataFrame:
    """Spikes, volume-confirmed 20-bar breaks and dry-ups."""
    x = _base(df).withColumn("bars_ago", w.bars_ago())
    if lookback is not None:
        x = x.where(F.col("bars_ago") < lookback)
    r = F.col("vol_ratio")
    brk = F.least((r - CONFIRM) / 2.5 + 0.5, F.lit(1.0))
    at_high = (r >= CONFIRM) & (F.col("close") >= F.col("__hi"))
    at_low = (r >= CONFIRM) & (F.col("close") <= F.col("__lo")) & ~w.flag(F.col("close") >= F.col("__hi"))
    dry = F.when(F.col("__a50") > 0, F.col("__a5") / F.col("__a50"))
    # fixed values: signal names and biases
    rows = [
        ("Volume Spike", F.when(F.col("__up"), "bullish").otherwise("bearish"), r >= SPIKE, (r - SPIKE) / 2.0 + 0.5),
        ("Breakout on Volume", F.lit("bullish"), at_high, brk),
        ("Breakdown on Volume", F.lit("bearish"), at_low, brk),
        ("Volume Dry-Up", F.lit("neutral"), dry <= DRY, 1.0 - dry),
    ]
    hits = [
        F.when(
            w.flag(cond),
            F.struct(
                F.lit(i).alias("rank"),
                F.lit(name).alias("name"),
                bias.alias("bias"),
                w.clip(score, 0.0, 1.0).alias("strength"),
            ),
        )
        for i, (name, bias, cond, score) in enumerate(rows)
    ]
    return x.select("symbol", "ts", "bars_ago", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def events(df: DataFrame, lookback: int | None = LOOKBACK) -> DataFrame:
    """Spikes, volume-confirmed 20-bar breaks and the two newest dry-ups."""
    ev = all_events(df, lookback)
    spec = Window.partitionBy("symbol", "name").orderBy(F.desc("ts"))
    return (
        ev.withColumn("__n", F.row_number().over(spec))
        .where((F.col("name") != "Volume Dry-Up") | (F.col("__n") <= 2))
        .drop("__n")
    )


def detect(df: DataFrame, lookback: int = LOOKBACK, max_signals: int = MAX_SIGNALS) -> DataFrame:
    return candles.newest(events(df, lookback), max_signals).withColumn("category", F.lit("volume"))


def analysis(df: DataFrame) -> DataFrame:
    """One row per symbol: availability, latest volume ratio, OBV trend and the
    number of recent signals."""
    x = _base(df).withColumn("__a", w.bars_ago())
    head = x.groupBy("symbol").agg(
        (F.sum("__v") != 0).alias("available"),
        F.max(F.when(F.col("__a") == 0, F.col("vol_ratio"))).alias("latest_ratio"),
    )
    sig = detect(df).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_signals"))
    return (
        head.join(indicators.obv_trend(df), "symbol", "left")
        .join(sig, "symbol", "left")
        .select(
            "symbol",
            "available",
            F.when(F.col("available"), F.col("latest_ratio")).alias("latest_ratio"),
            F.when(F.col("available"), F.col("obv_trend")).otherwise("flat").alias("obv_trend"),
            F.when(F.col("available"), F.coalesce("n_signals", F.lit(0))).otherwise(0).cast("long").alias("n_signals"),
        )
    )
