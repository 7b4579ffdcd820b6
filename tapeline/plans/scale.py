"""The chunked path for few symbols with long histories, against the same text
as the plain path."""

from __future__ import annotations

from ..operators import chunks as K
from . import panels as P
from .indicators import WS, full, numbered, recur
from .registry import query

T = P.bars_sql("type")


@query(
    "chunked_ordinal",
    "A5",
    P.with_(P.bars_sql("brand")) + f"SELECT symbol, ts, row_number() OVER ({WS}) - 1 AS i FROM bars",
)
def chunked_ordinal(spark, d):
    return K.with_ordinal(P.brand_bars(spark, d)).select("symbol", "ts", "i")


@query(
    "chunked_rolling",
    "B3 B10 B11",
    P.with_(T)
    + f"SELECT symbol, ts, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200, {full('max', 'high', 50)} AS max50, {full('stddev_samp', 'close', 20)} AS sd20 FROM bars",
)
def chunked_rolling(spark, d):
    cols = {"sma50": ("avg", "close", 50), "sma200": ("avg", "close", 200), "max50": ("max", "high", 50), "sd20": ("stddev_samp", "close", 20)}
    return K.rolling(P.type_bars(spark, d), cols, 256).select("symbol", "ts", *cols)


@query(
    "chunked_running_sum",
    "B12",
    P.with_(T) + f"SELECT symbol, ts, sum(volume) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS total FROM bars",
)
def chunked_running_sum(spark, d):
    return K.running_sum(P.type_bars(spark, d), "volume", "total", 256).select("symbol", "ts", "total")


@query(
    "chunked_ema",
    "B4",
    P.with_(numbered(T), recur({"ema12": ("close", "2.0/13")}), recursive=True) + "SELECT b.symbol, b.ts, ema12 FROM b JOIN e USING (symbol, k)",
)
def chunked_ema(spark, d):
    return K.ewm(P.type_bars(spark, d), "close", 2.0 / 13, "ema12").select("symbol", "ts", "ema12")


@query("bars_of_bars", "A1 A4", P.with_(T) + "SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, max(high) AS high, min(low) AS low FROM bars GROUP BY 1, 2")
def bars_of_bars(spark, d):
    from pyspark.sql import functions as F

    x = P.type_bars(spark, d)
    return x.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
