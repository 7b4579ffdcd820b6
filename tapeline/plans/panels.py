"""Panels derived from the given tables, in Spark and as DuckDB text.

=======  ==========================  =======================================
panel    symbol                      trades
=======  ==========================  =======================================
type     ``p_type``                  lineitem x part
brand    ``p_brand``                 lineitem x part
nation   nation name, sector=region  orders x customer x nation x region
event    ``event_type``, hourly      events
=======  ==========================  =======================================

Column lists are selected before the joins, so only those reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..sources import bars as B


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_trades(spark: SparkSession, d: str, symbol: str) -> DataFrame:
    """Trades of lineitem by a part attribute.

    ``seq`` packs order, line and a mix of the remaining columns into one long:
    a fixed-width rank of the trades that share a ship date.  Parts grow with the
    trades, so the join is a sort-merge join and no table passes the driver."""
    mix = (
        F.col("l_partkey") * 31
        + F.col("l_suppkey") * 7
        + F.round(F.col("l_extendedprice") * 100).cast("long") * 13
        + F.col("l_quantity").cast("long")
    ) % F.lit(1048576)
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(1048576) + mix
    li = table(spark, d, "lineitem").select(
        "l_partkey",
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        seq.alias("seq"),
    )
    part = table(spark, d, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    return li.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select("symbol", "ts", "price", "qty", "seq")


def nation_trades(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "symbol",
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_totalprice").alias("price"),
            F.lit(1.0).alias("qty"),
            F.col("o_orderkey").alias("seq"),
        )
    )


def nations(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("symbol"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "symbol", "sector")


def event_trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("qty")
    )


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written on first use in a session and read after that.

    Bars are the silver table of every query: one row per symbol and interval,
    a tiny fraction of the trades, so the trades are scanned once however often
    a query or its neighbours read the panel."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SHARED:
        _SHARED[key] = session.as_table(build(), name)
    return _SHARED[key]


def release() -> None:
    """Forget every derived table and unpersist intermediates."""
    session.release()
    _SHARED.clear()


def type_bars(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "type", lambda: B.bars_from_trades(part_trades(spark, d, "p_type"), "1d", "seq"))


def brand_bars(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "brand", lambda: B.bars_from_trades(part_trades(spark, d, "p_brand"), "1d", "seq"))


def nation_bars(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "nation", lambda: B.bars_from_trades(nation_trades(spark, d), "1d", "seq"))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    return nations(spark, d).select("symbol", "sector")


def event_bars(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "event", lambda: B.bars_from_trades(event_trades(spark, d), "1h", "ts"))


def type_px(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "type_px", lambda: B.damped(type_bars(spark, d)))


def brand_px(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "brand_px", lambda: B.damped(brand_bars(spark, d)))


def nation_px(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "nation_px", lambda: B.damped(nation_bars(spark, d)))


def market(px: DataFrame) -> DataFrame:
    """Equal-weight mean close of a panel: the benchmark series."""
    return px.groupBy("ts").agg(F.avg("close").alias("close"))


# ---------------------------------------------------------------- DuckDB text

_SEQ = (
    "(l_orderkey * 8 + l_linenumber) * 1048576 + "
    "(l_partkey * 31 + l_suppkey * 7 + CAST(round(l_extendedprice * 100) AS BIGINT) * 13 "
    "+ CAST(l_quantity AS BIGINT)) % 1048576"
)


def _part_sql(symbol: str, name: str) -> str:
    return f"""{name}_trades AS (
  SELECT {symbol} AS symbol, l_shipdate AS ts, l_extendedprice AS price, l_quantity AS qty, {_SEQ} AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


_TRADES = {
    "type": _part_sql("p_type", "type"),
    "brand": _part_sql("p_brand", "brand"),
    "nation": """nation_trades AS (
  SELECT n_name AS symbol, o_orderdate AS ts, o_totalprice AS price, 1.0::DOUBLE AS qty, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "event": """event_trades AS (
  SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS qty, epoch_us(ts) AS seq FROM events)""",
}


def trades_sql(panel: str) -> str:
    return _TRADES[panel]


def bars_sql(panel: str, alias: str = "bars") -> str:
    unit = "hour" if panel == "event" else "day"
    return f"""{_TRADES[panel]},
{alias} AS MATERIALIZED (
  SELECT symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, arg_min(price, seq) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume
  FROM {panel}_trades GROUP BY 1, 2)"""


def px_sql(panel: str, alias: str = "px") -> str:
    return f"""{bars_sql(panel, alias + '_raw')},
{alias}_m AS (SELECT *, ln(close) - avg(ln(close)) OVER (PARTITION BY symbol) AS dev,
       avg(ln(close)) OVER (PARTITION BY symbol) AS mu FROM {alias}_raw),
{alias}_c AS (SELECT *, sum(0.02 * dev) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum
  FROM {alias}_m),
{alias} AS MATERIALIZED (SELECT symbol, ts,
    97 * exp(cum - 0.02 * dev + 0.02 * (ln(open) - mu)) AS open,
    97 * exp(cum - 0.02 * dev + 0.02 * (ln(high) - mu)) AS high,
    97 * exp(cum - 0.02 * dev + 0.02 * (ln(low) - mu)) AS low,
    97 * exp(cum - 0.02 * dev + 0.02 * dev) AS close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
    count(*) OVER (PARTITION BY symbol) AS n
  FROM {alias}_c)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


SECTORS_SQL = "sectors AS (SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"
