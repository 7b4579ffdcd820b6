"""Bars, calendars and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..sources import bars as B
from . import panels as P
from .registry import query

T = P.bars_sql("type")
COLS = "symbol, ts, open, high, low, close, volume"


@query("bars_daily", "A1", P.with_(P.bars_sql("brand")) + f"SELECT {COLS} FROM bars")
def bars_daily(spark, d):
    return P.brand_bars(spark, d)


@query("bars_hourly", "A1", P.with_(P.bars_sql("event")) + f"SELECT {COLS} FROM bars")
def bars_hourly(spark, d):
    return P.event_bars(spark, d)


def _bars_at(unit: str) -> str:
    return (
        P.with_(P.trades_sql("type"))
        + f"""SELECT symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(qty) AS volume FROM type_trades GROUP BY 1, 2"""
    )


def _rolled_up(spark, d, interval: str):
    """Coarser bars from daily bars: already aggregated rows, no second pass over trades."""
    unit = B.INTERVALS[interval]
    return (
        P.type_bars(spark, d)
        .groupBy("symbol", F.date_trunc(unit, "ts").alias("bucket"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "ts")
    )


@query("bars_weekly", "A1", _bars_at("week"))
def bars_weekly(spark, d):
    return _rolled_up(spark, d, "1wk")


@query("bars_monthly", "A1", _bars_at("month"))
def bars_monthly(spark, d):
    return _rolled_up(spark, d, "1mo")


@query(
    "clean_bars",
    "A2",
    P.with_(T)
    + f"SELECT upper(trim(symbol)) AS symbol, ts, open, high, low, close, CASE WHEN volume < 200 THEN NULL ELSE volume END AS volume "
    "FROM bars WHERE close <= 90000",
)
def clean_bars(spark, d):
    dirty = P.type_bars(spark, d).withColumns(
        {
            "symbol": F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")),
            "close": F.when(F.col("close") > 90000, F.lit(float("nan"))).otherwise(F.col("close")),
            "volume": F.when(F.col("volume") >= 200, F.col("volume")),
        }
    )
    return B.clean_bars(dirty)


@query(
    "trailing_period",
    "A3",
    P.with_(T)
    + f"SELECT {COLS} FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS t FROM bars) WHERE ts >= CAST(t - INTERVAL 24 MONTH AS TIMESTAMP)",
)
def trailing_period(spark, d):
    return B.trailing_period(P.type_bars(spark, d), "2y")


@query(
    "resample_weekly_last",
    "A4",
    P.with_(T)
    + """SELECT symbol, CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS TIMESTAMP) AS week_end,
 arg_max(close, ts) AS close FROM bars GROUP BY 1, 2""",
)
def resample_weekly_last(spark, d):
    return B.resample_last(P.type_bars(spark, d))


@query(
    "calendar",
    "A5",
    P.with_(P.bars_sql("brand"))
    + """SELECT b.symbol, b.ts, c.ci, row_number() OVER (PARTITION BY symbol ORDER BY b.ts) - 1 AS bi FROM bars b JOIN
 (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ci FROM (SELECT DISTINCT ts FROM bars)) c ON b.ts = c.ts""",
)
def calendar(spark, d):
    b = P.brand_bars(spark, d)
    return b.join(B.calendar(b), "ts").select("symbol", "ts", "ci", w.bar_no().alias("bi"))


DENSE = """cal AS (SELECT DISTINCT ts FROM bars), syms AS (SELECT DISTINCT symbol FROM bars),
dense AS (SELECT s.symbol, c.ts, b.close FROM syms s CROSS JOIN cal c LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = c.ts)"""


@query(
    "densify",
    "A6 J10",
    P.with_(P.bars_sql("brand"), DENSE)
    + """SELECT symbol, ts, close, CASE WHEN count(close) OVER w >= 3 THEN avg(close) OVER w END AS sma3_panel
FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def densify(spark, d):
    x = B.densify(P.brand_bars(spark, d).select("symbol", "ts", "close"))
    return x.select("symbol", "ts", "close", w.roll(F.avg, "close", 3).alias("sma3_panel"))


@query(
    "unstack",
    "A7",
    P.with_(P.bars_sql("nation"))
    + "SELECT ts, "
    + ", ".join(f"max(close) FILTER (symbol = 'NATION_{i}') AS NATION_{i}" for i in range(25))
    + " FROM bars GROUP BY ts",
)
def unstack(spark, d):
    return B.unstack(P.nation_bars(spark, d), [f"NATION_{i}" for i in range(25)])


@query(
    "stack",
    "A7",
    P.with_(P.bars_sql("nation")) + "SELECT symbol, ts, close FROM bars",
)
def stack(spark, d):
    return B.stack(B.unstack(P.nation_bars(spark, d), [f"NATION_{i}" for i in range(25)]))


@query(
    "to_candles",
    "A8",
    P.with_(T)
    + """SELECT symbol, CAST(epoch(ts) AS BIGINT) AS time, strftime(ts, '%Y-%m-%d') AS date, round(open, 4) AS open, round(high, 4) AS high,
 round(low, 4) AS low, round(close, 4) AS close, CAST(floor(coalesce(volume, 0)) AS BIGINT) AS volume FROM bars""",
)
def to_candles(spark, d):
    return B.to_candles(P.type_bars(spark, d))


@query(
    "line_series",
    "A9",
    P.with_(T, "m AS (SELECT symbol, ts, CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))")
    + "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS time, v AS value FROM m WHERE v IS NOT NULL",
)
def line_series(spark, d):
    x = P.type_bars(spark, d).withColumn("sma20", w.roll(F.avg, "close", 20))
    return B.line_series(x, "sma20")
