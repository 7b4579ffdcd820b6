"""Structured Streaming twins of the batch operators.

Each builder maps a streaming frame to a streaming frame and also runs on a
batch frame where that makes sense, so the twin test is direct.  Sinks are
tables in the shared folder, never the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_dir

TRADE_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_trades(spark: SparkSession, d: str, files_per_trigger: int | None = None) -> DataFrame:
    """Trades of the events table as a stream of files."""
    r = spark.readStream.schema(TRADE_SCHEMA).option("pathGlobFilter", "events.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(d).select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), "user_id"
    )


def stream_bars(trades: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tumbling OHLCV bars; a bar appears once the watermark passes its end and
    trades later than ``delay`` are dropped."""
    return (
        trades.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def day_quotes(trades: DataFrame) -> DataFrame:
    """Running last price, range and count per symbol and day (update or complete mode)."""
    return trades.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.max_by("price", "ts").alias("price"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.count(F.lit(1)).alias("trades"),
        F.max("ts").alias("as_of"),
    )


def live_quotes(days: DataFrame) -> DataFrame:
    """The quote of each symbol from its day table: last price, close of the day
    before and the change from it, range and trades of the day."""
    by_day = Window.partitionBy("symbol").orderBy("day")
    x = days.withColumns({"prev_close": F.lag("price").over(by_day), "last": F.max("day").over(Window.partitionBy("symbol"))})
    return x.where(F.col("day") == F.col("last")).select(
        "symbol", "price", "prev_close", (F.try_divide("price", "prev_close") - 1.0).alias("change"), F.col("high").alias("day_high"), F.col("low").alias("day_low"), "trades", "as_of"
    )


def mean_volume(daily: DataFrame, bars: int = 50) -> DataFrame:
    """(symbol, avg_volume): the mean of the newest ``bars`` daily volumes."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return daily.withColumn("__p", F.row_number().over(newest)).where(F.col("__p") <= bars).groupBy("symbol").agg(F.avg("volume").alias("avg_volume"))


def sliding_volume(trades: DataFrame, averages: DataFrame, width: str = "1 day", slide: str = "6 hours", delay: str = "2 hours", spike: float = 2.0) -> DataFrame:
    """Sliding-window volume against a static average per symbol; rows at or over
    ``spike`` times the average.  ``averages``: symbol, avg_volume."""
    g = trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.sum("qty").alias("volume"))
    x = g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "volume")
    x = x.join(averages, "symbol").withColumn("vol_ratio", F.try_divide("volume", "avg_volume"))
    return x.where(F.col("vol_ratio") >= spike).drop("avg_volume")


def ledger_ingest(signals: DataFrame, delay: str = "2 days") -> DataFrame:
    """Exactly one row per (day, symbol, type) however often a call is polled."""
    return (
        signals.withColumn("day", F.date_trunc("day", "ts"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["day", "symbol", "signal_type"])
    )


def session_bars(trades: DataFrame, gap: str = "30 minutes", delay: str | None = "2 hours") -> DataFrame:
    """One bar per burst of activity, bursts being ``gap`` apart."""
    t = trades.withWatermark("ts", delay) if delay and trades.isStreaming else trades
    return (
        t.groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("trades"), F.min_by("price", "ts").alias("open"), F.max_by("price", "ts").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades", "open", "high", "low", "close")
    )


# ------------------------------------------------------ per-symbol state

_EMA_OUT = "symbol STRING, ts TIMESTAMP, close DOUBLE, ema DOUBLE, ewma_var DOUBLE, rsi DOUBLE"
_EMA_STATE = "n BIGINT, last DOUBLE, ema DOUBLE, var DOUBLE, gain DOUBLE, loss DOUBLE"


def online_recurrences(bars: DataFrame, span: int = 12, lam: float = 0.94, period: int = 14) -> DataFrame:
    """EMA, EWMA variance and RSI carried bar by bar in keyed state.

    Input is the finished-bar table, whose batches arrive in time order per
    symbol because the watermark released them; rows inside a batch are sorted."""
    a = 2.0 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import math

        n, last, ema, var, gain, loss = state.get if state.exists else (0, 0.0, 0.0, float("nan"), float("nan"), float("nan"))
        pdf = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, close in zip(pdf["ts"], pdf["close"]):
            if n == 0:
                ema = close
            else:
                ema += a * (close - ema)
                r2 = math.log(close / last) ** 2 if close > 0 and last > 0 else 0.0
                up, down = max(close - last, 0.0), max(last - close, 0.0)
                if n == 1:
                    var, gain, loss = r2, up, down
                else:
                    var = lam * var + (1 - lam) * r2
                    gain += (up - gain) / period
                    loss += (down - loss) / period
            n, last = n + 1, close
            rsi = None
            if n > period:
                if gain == 0 and loss == 0:
                    rsi = 50.0
                elif gain == 0:
                    rsi = 0.0
                elif loss == 0:
                    rsi = 100.0
                else:
                    rsi = 100 - 100 / (1 + gain / loss)
            out.append((key[0], ts, close, ema, None if n < 2 else var, rsi))
        state.update((n, float(last), float(ema), float(var), float(gain), float(loss)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema", "ewma_var", "rsi"])

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(step, _EMA_OUT, _EMA_STATE, "append", "NoTimeout")


_ALERT_OUT = "rule_id STRING, symbol STRING, ts TIMESTAMP, close DOUBLE"


def edge_alerts(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """Price rules that fire once when their condition turns true.

    ``rules``: rule_id, symbol, above (BOOLEAN), value.  The condition is a
    stream-static join; only the previous truth value is state."""
    hit = F.when(F.col("above"), F.col("close") > F.col("value")).otherwise(F.col("close") < F.col("value"))
    x = bars.join(rules, "symbol").select("rule_id", "symbol", "ts", "close", hit.alias("hit"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        pdf = pd.concat(list(batches)).sort_values("ts")
        prev = pdf["hit"].shift(1, fill_value=was).astype(bool)
        fired = pdf[pdf["hit"].astype(bool) & ~prev]
        state.update((bool(pdf["hit"].iloc[-1]),))
        yield fired[["rule_id", "symbol", "ts", "close"]]

    return x.groupBy("rule_id").applyInPandasWithState(step, _ALERT_OUT, "hit BOOLEAN", "append", "NoTimeout")


# ------------------------------------------------------ running to a table


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> str:
    """Drain the available input into a parquet table and return its path."""
    spark = stream.sparkSession
    path = fresh_dir(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_progress")
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", f"{path}/data").start()
        q.awaitTermination()
        return f"{path}/data"
    versions: list[str] = []
    writer.outputMode(mode).foreachBatch(_version(f"{path}/data", versions)).start().awaitTermination()
    return versions[-1]


def _version(path: str, versions: list[str]) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so readers of the one before are
    not disturbed; a repeated batch writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        to = f"{path}/v{number}"
        batch.write.mode("overwrite").parquet(to)
        versions.append(to)

    return write
