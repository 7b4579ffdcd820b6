"""Candlestick patterns as column expressions.

A pattern is a row of (name, bias, condition, score) over per-bar geometry and
at most two lagged bars.  Every bar carries an array of its hits, which
``inline`` turns into signal events; nothing is shuffled after the bar sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

TINY = 1e-9
LOOKBACK = 40
MAX_SIGNALS = 12


def geometry(df: DataFrame) -> DataFrame:
    """Body, range, shadows, the prior-trend sign and two earlier bars."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns(
        {
            "body": c - o,
            "size": F.abs(c - o),
            "rng": F.greatest(h - l, F.lit(TINY)),
            "upper": h - F.greatest(o, c),
            "lower": F.least(o, c) - l,
            "trend": F.coalesce(F.signum(w.lag("close", 1) - w.lag("close", 5)), F.lit(0.0)),
        }
    )
    for n in (1, 2):
        df = df.withColumns({f"o{n}": w.lag("open", n), f"c{n}": w.lag("close", n)})
    return df


def _catalogue() -> list[tuple[str, str, Column, Column]]:
    o, c = F.col("open"), F.col("close")
    body, size, rng = F.col("body"), F.col("size"), F.col("rng")
    upper, lower, trend = F.col("upper"), F.col("lower"), F.col("trend")
    o1, c1, o2, c2 = (F.col(x) for x in ("o1", "c1", "o2", "c2"))
    up, down = body > 0, body < 0
    b1, b2 = c1 - o1, c2 - o2
    s1, s2 = F.abs(b1), F.abs(b2)
    mid1, mid2 = (o1 + c1) / 2.0, (o2 + c2) / 2.0
    one = F.lit(1.0)

    full = (upper < 0.05 * rng) & (lower < 0.05 * rng) & (size > 0.6 * rng)
    full_score = 0.6 + 0.4 * (1.0 - (upper + lower) / (0.1 * rng))
    compact = (size <= 0.4 * rng) & (size > 0)
    low_tail = (lower >= 2 * size) & (upper <= 0.3 * size + 0.05 * rng) & compact
    high_tail = (upper >= 2 * size) & (lower <= 0.3 * size + 0.05 * rng) & compact
    low_score = 0.4 + 0.15 * (lower / (size + TINY) - 2)
    high_score = 0.4 + 0.15 * (upper / (size + TINY) - 2)
    cover = 0.5 + 0.5 * F.least((size - s1) / (s1 + TINY), one)
    nested = 0.4 + 0.5 * (1.0 - size / (s1 + TINY))
    star = s1 < s2 * 0.5
    strong = size > s2 * 0.5
    # fixed values: pattern names, biases and score weights
    return [
        ("Doji", "neutral", size <= 0.1 * rng, 0.4 + 0.6 * (1.0 - size / (0.1 * rng))),
        ("Bullish Marubozu", "bullish", full & up, full_score),
        ("Bearish Marubozu", "bearish", full & down, full_score),
        ("Hammer", "bullish", low_tail & (trend < 0), low_score),
        ("Hanging Man", "bearish", low_tail & (trend > 0), low_score),
        ("Inverted Hammer", "bullish", high_tail & (trend < 0), high_score),
        ("Shooting Star", "bearish", high_tail & (trend > 0), high_score),
        ("Bullish Engulfing", "bullish", (b1 < 0) & up & (o <= c1) & (c >= o1) & (size > s1), cover),
        ("Bearish Engulfing", "bearish", (b1 > 0) & down & (o >= c1) & (c <= o1) & (size > s1), cover),
        ("Bullish Harami", "bullish", (b1 < 0) & up & (size < s1) & (o >= c1) & (c <= o1), nested),
        ("Bearish Harami", "bearish", (b1 > 0) & down & (size < s1) & (o <= c1) & (c >= o1), nested),
        (
            "Piercing Line",
            "bullish",
            (b1 < 0) & up & (o <= c1) & (c > mid1) & (c < o1),
            0.5 + 0.4 * F.least((c - mid1) / (s1 / 2.0 + TINY), one),
        ),
        (
            "Dark Cloud Cover",
            "bearish",
            (b1 > 0) & down & (o >= c1) & (c < mid1) & (c > o1),
            0.5 + 0.4 * F.least((mid1 - c) / (s1 / 2.0 + TINY), one),
        ),
        (
            "Morning Star",
            "bullish",
            (b2 < 0) & star & up & strong & (c > mid2),
            0.55 + 0.4 * F.least((c - mid2) / (s2 / 2.0 + TINY), one),
        ),
        (
            "Evening Star",
            "bearish",
            (b2 > 0) & star & down & strong & (c < mid2),
            0.55 + 0.4 * F.least((mid2 - c) / (s2 / 2.0 + TINY), one),
        ),
        (
            "Three White Soldiers",
            "bullish",
            (b2 > 0) & (b1 > 0) & up & (c1 > c2) & (c > c1) & (o2 < o1) & (o1 < c2) & (o1 < o) & (o < c1),
            F.lit(0.7),
        ),
        (
            "Three Black Crows",
            "bearish",
            (b2 < 0) & (b1 < 0) & down & (c1 < c2) & (c < c1) & (c2 < o1) & (o1 < o2) & (c1 < o) & (o < o1),
            F.lit(0.7),
        ),
    ]


def with_hits(df: DataFrame, out: str = "hits") -> DataFrame:
    """Bars with an array of ``struct(rank, name, bias, strength)``."""
    keep = df.columns
    rows = [
        F.when(
            w.flag(cond),
            F.struct(
                F.lit(i).alias("rank"),
                F.lit(name).alias("name"),
                F.lit(bias).alias("bias"),
                F.greatest(F.lit(0.3), F.least(F.lit(1.0), score)).alias("strength"),
            ),
        )
        for i, (name, bias, cond, score) in enumerate(_catalogue())
    ]
    return geometry(df).withColumn(out, F.filter(F.array(*rows), lambda x: x.isNotNull())).select(*keep, out)


def events(df: DataFrame, lookback: int | None = None) -> DataFrame:
    """One row per pattern hit: symbol, ts, bars_ago, rank, name, bias, strength."""
    x = with_hits(df).withColumn("bars_ago", w.bars_ago())
    if lookback is not None:
        x = x.where(F.col("bars_ago") < lookback)
    return x.where(F.size("hits") > 0).select("symbol", "ts", "bars_ago", F.inline("hits"))


def newest(ev: DataFrame, limit: int, keys: list[str] | None = None) -> DataFrame:
    """Newest ``limit`` events per symbol, ties in catalogue order."""
    keys = keys or ["symbol"]
    spec = Window.partitionBy(*keys).orderBy(F.desc("ts"), "rank")
    return ev.withColumn("pos", F.row_number().over(spec)).where(F.col("pos") <= limit)


def detect(df: DataFrame, lookback: int = LOOKBACK, max_signals: int = MAX_SIGNALS) -> DataFrame:
    return newest(events(df, lookback), max_signals).withColumn("category", F.lit("candlestick"))
