"""Bars from trades, and the calendar around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import windows as w

INTERVALS = {"1h": "hour", "1d": "day", "1wk": "week", "1mo": "month"}
# trailing periods in months; None keeps everything
PERIODS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120, "max": None}
DEFAULT_PERIOD = "1y"
OHLC = ["open", "high", "low", "close"]


def bars_from_trades(trades: DataFrame, interval: str = "1d", order: str | Column | None = None) -> DataFrame:
    """OHLCV bars in one partial + final aggregation.

    ``order`` ranks the trades of a bar.  A fixed-width column (long,
    timestamp) keeps the aggregation a hash aggregation with map-side combine,
    so a symbol with a third of all trades ships one row per map task and bar;
    the default ``(ts, price, qty)`` struct is complete but sorts instead.
    """
    schemas.require(trades, schemas.TRADES, "trades")
    unit = INTERVALS.get(interval, "day")
    key = order if order is not None else F.struct("ts", "price", "qty")
    key = F.col(key) if isinstance(key, str) else key
    return (
        trades.select("symbol", F.date_trunc(unit, "ts").alias("ts"), "price", "qty", key.alias("__k"))
        .where(F.col("price").isNotNull())
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("price", "__k").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "__k").alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


def clean_bars(bars: DataFrame) -> DataFrame:
    """Upper-cased trimmed symbols; rows without a full OHLC set are dropped, a
    NULL volume is kept; NaN counts as NULL."""
    out = bars.withColumn("symbol", F.upper(F.trim("symbol")))
    for c in [*OHLC, "volume"]:
        out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return out.where(F.col("symbol") != "").dropna(subset=OHLC)


def trailing_period(bars: DataFrame, period: str = DEFAULT_PERIOD, interval: str = "1d") -> DataFrame:
    """The last ``period`` of each symbol; an unknown period means one year and
    hourly bars are held to two years."""
    period = period if period in PERIODS else DEFAULT_PERIOD
    if interval == "1h" and period in ("5y", "10y", "max"):
        period = "2y"
    months = PERIODS[period]
    if months is None:
        return bars
    newest = F.max("ts").over(w.whole())
    return bars.withColumn("__t", newest).where(F.col("ts") >= F.add_months("__t", -months)).drop("__t")


def resample_last(bars: DataFrame) -> DataFrame:
    """Last close of each week ending on Friday."""
    friday = F.next_day(F.date_sub(F.to_date("ts"), 1), "FRI").cast("timestamp")
    return bars.groupBy("symbol", friday.alias("week_end")).agg(F.max_by("close", "ts").alias("close"))


def calendar(bars: DataFrame) -> DataFrame:
    """Union of all bar dates with a dense 0-based ordinal ``ci`` and the length ``cn``.

    Two passes keep it parallel: days are counted per month, the month offsets
    are prefix sums over that small table, and the order inside a month is a
    window of at most 31 (or 744 hourly) rows."""
    days = bars.select("ts").distinct().withColumn("__m", F.date_trunc("month", "ts"))
    months = days.groupBy("__m").agg(F.count(F.lit(1)).alias("__n"))
    one = Window.partitionBy(F.lit(0))
    before = one.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(
        "__m",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(one).alias("cn"),
    )
    inside = Window.partitionBy("__m").orderBy("ts")
    return days.join(months, "__m").select(
        "ts", (F.col("__before") + F.row_number().over(inside) - 1).cast("long").alias("ci"), "cn"
    )


def with_calendar(bars: DataFrame) -> DataFrame:
    """Bars with the union-calendar ordinal ``ci`` and the calendar length ``cn``."""
    return bars.join(calendar(bars), "ts")


def densify(bars: DataFrame, ffill: int = 0) -> DataFrame:
    """Panel mode: every symbol on every calendar date, NULL where it has no bar.

    The result is symbols x dates by definition.  Symbols take the months (one
    short scalar array), and each month brings its dates."""
    dates = calendar(bars).select("ts", F.date_trunc("month", "ts").alias("__m"))
    months = dates.agg(F.collect_set("__m")).scalar()
    grid = bars.select("symbol").distinct().select("symbol", F.explode(months).alias("__m")).join(dates, "__m").select("symbol", "ts")
    out = grid.join(bars, ["symbol", "ts"], "left")
    if ffill:
        spec = w.by().rowsBetween(-ffill, 0)
        for c in [c for c in bars.columns if c not in ("symbol", "ts")]:
            out = out.withColumn(c, F.last(c, ignorenulls=True).over(spec))
    return out


def unstack(bars: DataFrame, symbols: list[str], value: str = "close") -> DataFrame:
    """Wide export: one column per named symbol."""
    return bars.groupBy("ts").pivot("symbol", symbols).agg(F.max(value))


def stack(wide: DataFrame, value: str = "close") -> DataFrame:
    """Long form of a wide frame; empty cells become absent rows."""
    names = [c for c in wide.columns if c != "ts"]
    return wide.unpivot(["ts"], names, "symbol", value).where(F.col(value).isNotNull())


def to_candles(bars: DataFrame) -> DataFrame:
    """Export rows: epoch seconds, four decimals, NULL volume as 0."""
    return bars.select(
        "symbol",
        F.unix_timestamp("ts").alias("time"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        *[F.round(c, 4).alias(c) for c in OHLC],
        F.coalesce(F.floor("volume"), F.lit(0)).cast("long").alias("volume"),
    )


def line_series(df: DataFrame, column: str) -> DataFrame:
    """(symbol, time, value) with NULL values dropped."""
    return df.select("symbol", F.unix_timestamp("ts").alias("time"), F.col(column).alias("value")).dropna(
        subset=["value"]
    )


def damped(bars: DataFrame, k: float = 0.02, start: float = 97.0) -> DataFrame:
    """A stock-like path from bars whose prices jump freely: the log distance
    of every price from the symbol's mean log close, scaled by ``k``, is read
    as that bar's log return and compounded from ``start``."""
    mean = F.avg(F.log("close")).over(w.whole())
    out = bars.withColumn("__m", mean).withColumn("__r", F.lit(k) * (F.log("close") - F.col("__m")))
    out = out.withColumn("__cum", F.sum("__r").over(w.history()))
    base = F.col("__cum") - F.col("__r")
    for c in ("open", "high", "low"):
        out = out.withColumn(c, F.lit(start) * F.exp(base + F.lit(k) * (F.log(c) - F.col("__m"))))
    out = out.withColumn("close", F.lit(start) * F.exp(base + F.col("__r")))
    return out.drop("__m", "__r", "__cum")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by year, so period filters prune files."""
    bars.withColumn("year", F.year("ts")).repartition("year", "symbol").sortWithinPartitions(
        "symbol", "ts"
    ).write.mode("overwrite").partitionBy("year").parquet(path)


def read_bars(spark, path: str, since: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if since:
        df = df.where((F.col("year") >= int(since[:4])) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    return df.select(*schemas.BARS.fieldNames())
