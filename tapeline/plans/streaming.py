"""Streaming queries drained to a table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_dir
from ..streaming import jobs as J
from ..streaming import stateful as ST
from . import panels as P
from .indicators import RSI_WILDER_SQL, gains, numbered, recur
from .posture import scored_daily, series_ctes
from .registry import query
from .trades import _DIP_BARS, walk

EB = P.bars_sql("event")
DONE = "fin AS MATERIALIZED (SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)"


def finished(spark, d) -> str:
    return J.run_to_table(J.stream_bars(J.read_trades(spark, d)), "stream_bars")


@query("stream_bars", "P1", P.with_(EB, DONE) + "SELECT symbol, ts, open, high, low, close, volume FROM fin")
def stream_bars(spark, d):
    return spark.read.parquet(finished(spark, d))


@query(
    "live_quotes",
    "P2",
    """WITH dq AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_max(value, ts) AS price, max(value) AS day_high, min(value) AS day_low, count(*) AS trades, max(ts) AS as_of FROM events GROUP BY 1, 2),
r AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY day) AS prev_close, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM dq)
SELECT symbol, price, prev_close, price / prev_close - 1 AS change, day_high, day_low, trades, as_of FROM r WHERE k = 1""",
)
def live_quotes(spark, d):
    return J.live_quotes(spark.read.parquet(J.run_to_table(J.day_quotes(J.read_trades(spark, d)), "day_quotes", "complete")))


@query(
    "sliding_volume",
    "P3",
    P.with_(
        "dv AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, count(*) AS v FROM events GROUP BY 1, 2)",
        "av AS (SELECT symbol, avg(v) AS a FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM dv) WHERE k <= 50 GROUP BY 1)",
        "sl AS (SELECT event_type AS symbol, s AS start, CAST(s + INTERVAL 24 HOUR AS TIMESTAMP) AS \"end\", CAST(count(*) AS DOUBLE) AS volume FROM events, (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 6 HOUR)) AS s) WHERE ts >= s AND ts < s + INTERVAL 24 HOUR GROUP BY 1, 2, 3)",
    )
    + "SELECT sl.*, volume / a AS vol_ratio FROM sl JOIN av USING (symbol) WHERE volume / a >= 1.2 AND \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
)
def sliding_volume(spark, d):
    daily = P.event_trades(spark, d).groupBy("symbol", F.to_date("ts").alias("ts")).agg(F.count(F.lit(1)).alias("volume"))
    # the given events are even: a spike of 1.2 shows rows, the rule's 2 has a test of its own
    return spark.read.parquet(J.run_to_table(J.sliding_volume(J.read_trades(spark, d), J.mean_volume(daily), spike=1.2), "sliding_volume"))


@query("ledger_ingest", "P4", "SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(user_id AS VARCHAR) AS symbol, event_type AS signal_type FROM events")
def ledger_ingest(spark, d):
    s = J.read_trades(spark, d).select("ts", F.col("user_id").cast("string").alias("symbol"), F.col("symbol").alias("signal_type"))
    return spark.read.parquet(J.run_to_table(J.ledger_ingest(s), "ledger_ingest")).select("day", "symbol", "signal_type")


def _bar_stream(spark, d):
    path = finished(spark, d)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query(
    "edge_alerts",
    "P5",
    P.with_(
        EB,
        DONE,
        "rl AS (SELECT DISTINCT symbol, symbol || ':' || v AS rule_id, ab AS above, v::DOUBLE AS value FROM fin, (VALUES (true, 40), (false, 5)) AS t(ab, v))",
        "h AS (SELECT rule_id, fin.symbol, ts, close, CASE WHEN above THEN close > value ELSE close < value END AS hit FROM fin JOIN rl USING (symbol))",
        "p AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY rule_id ORDER BY ts), false) AS was FROM h)",
    )
    + "SELECT rule_id, symbol, ts, close FROM p WHERE hit AND NOT was",
)
def edge_alerts(spark, d):
    kinds = F.array(
        F.struct(F.lit(True).alias("above"), F.lit(40).alias("v")), F.struct(F.lit(False).alias("above"), F.lit(5).alias("v"))
    )
    syms = P.event_bars(spark, d).select("symbol").distinct().select("symbol", F.explode(kinds).alias("k"))
    rules = syms.select(F.concat_ws(":", "symbol", "k.v").alias("rule_id"), "symbol", "k.above", F.col("k.v").cast("double").alias("value"))
    return spark.read.parquet(J.run_to_table(J.edge_alerts(_bar_stream(spark, d), rules), "edge_alerts"))


@query(
    "online_recurrences",
    "P6",
    P.with_(
        EB,
        DONE,
        numbered("z AS (SELECT 1)", "fin"),
        recur({"ema": ("close", "2.0/13")}),
        recur(gains(14), first="k = 2", name="gl"),
        "lr AS MATERIALIZED (SELECT symbol, k, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ** 2 ELSE 0 END AS r2 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
        recur({"ev": ("r2", "0.06")}, src="lr", first="k = 2", name="vr"),
        recursive=True,
    )
    + f"SELECT b.symbol, b.ts, b.close, ema, ev AS ewma_var, {RSI_WILDER_SQL.format(p=14)} AS rsi FROM b JOIN e USING (symbol, k) LEFT JOIN gl USING (symbol, k) LEFT JOIN vr USING (symbol, k)",
)
def online_recurrences(spark, d):
    return spark.read.parquet(J.run_to_table(J.online_recurrences(_bar_stream(spark, d)), "online_recurrences"))


def keyed(spark, stream, name: str):
    """A keyed job drained to a table and read back."""
    with ST.keyed_state(spark):
        return spark.read.parquet(J.run_to_table(stream, name))


@query(
    "online_state",
    "P6",
    P.with_(
        EB,
        DONE,
        "fx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM fin)",
        numbered("z AS (SELECT 1)", "fx"),
        recur({"ema": ("close", "2.0/13")}),
        recur(gains(14), first="k = 2", name="gl"),
        "lr AS MATERIALIZED (SELECT symbol, k, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ** 2 ELSE 0 END AS r2 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
        recur({"ev": ("r2", "0.06")}, src="lr", first="k = 2", name="vr"),
        *_DIP_BARS,
        *walk("dip", "dt"),
        recursive=True,
    )
    + f"""SELECT b.symbol, b.ts, b.close, ema, ev AS ewma_var, {RSI_WILDER_SQL.format(p=14)} AS rsi, dp.rsi2, coalesce(dtw.held, false) AS in_dip, dtw.ret AS dip_ret FROM b JOIN e USING (symbol, k) LEFT JOIN gl USING (symbol, k)
 LEFT JOIN vr USING (symbol, k) JOIN dp USING (symbol, k) LEFT JOIN dtw ON dtw.symbol = b.symbol AND dtw.i = b.i WHERE b.ts <= (SELECT max(ts) FROM fin) - INTERVAL 1 HOUR""",
)
def online_state(spark, d):
    return keyed(spark, ST.online_state(_bar_stream(spark, d)), "online_state")


# every rule type for every symbol; one rule changes its value, one ends
_ALERTS = [("rsi_below", 30.0), ("rsi_above", 70.0), ("price_below", 95.0), ("price_above", 100.0), ("confidence_above", 60.0), ("verdict_buy", None), ("verdict_sell", None), ("stage2", None), ("golden", None), ("death", None)]
_START, _CHANGE, _END = "1992-01-01", "1996-06-03", "1997-06-02"


def alert_changes(spark, d):
    """The rule stream: rows of rule_id, symbol, ts, type, value, until."""
    rows = [(t, v, _START, _END if t == "price_above" else None) for t, v in _ALERTS] + [("rsi_below", 40.0, _CHANGE, None)]
    kinds = spark.createDataFrame(rows, "type string, value double, ts string, until string")
    syms = P.type_px(spark, d).select("symbol").distinct()
    x = syms.join(F.broadcast(kinds))
    return x.select(F.concat_ws(":", "type", "symbol").alias("rule_id"), "symbol", F.col("ts").cast("timestamp").alias("ts"), "type", "value", F.col("until").cast("timestamp").alias("until"))


def _as_stream(spark, df, name: str):
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


_HOLDS = """CASE type WHEN 'rsi_below' THEN rv < value WHEN 'rsi_above' THEN rv > value WHEN 'price_below' THEN close < value WHEN 'price_above' THEN close > value WHEN 'confidence_above' THEN confidence > value
 WHEN 'verdict_buy' THEN verdict = 'BUY' WHEN 'verdict_sell' THEN verdict = 'SELL' WHEN 'stage2' THEN sc = 8 OR (sc >= 7 AND close > m150 AND close > m200 AND m150 > m200 AND m50 > m150 AND m50 > m200 AND close > m50)
 WHEN 'golden' THEN m50 > m200 WHEN 'death' THEN m200 IS NOT NULL AND NOT m50 > m200 END"""


_ENDS = {"price_above": f"TIMESTAMP '{_END}'", "rsi_below": f"TIMESTAMP '{_CHANGE}'"}


@query(
    "stream_alerts",
    "P5",
    P.with_(
        *series_ctes(1),
        "rl(type, value, a, z) AS (VALUES "
        + ", ".join(
            f"('{t}', {'NULL' if v is None else v}::DOUBLE, TIMESTAMP '{_START}', {_ENDS.get(t, 'CAST(NULL AS TIMESTAMP)')})" for t, v in _ALERTS
        )
        + f", ('rsi_below', 40.0, TIMESTAMP '{_CHANGE}', NULL))",
        "sn AS (SELECT pf.symbol, pf.ts, tc.close, tc.rsi AS rv, pf.confidence, pf.verdict, sc, m50, m150, m200 FROM pf JOIN tc USING (symbol, i) WHERE pf.ts <= (SELECT max(ts) FROM pf) - INTERVAL 1 DAY)",
        f"hd AS (SELECT type || ':' || symbol AS rule_id, symbol, type, a, ts, close, coalesce({_HOLDS}, false) AS hit FROM sn, rl WHERE ts >= a AND (z IS NULL OR ts < z))",
        "fd AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY rule_id, a ORDER BY ts), false) AS was FROM hd)",
        recursive=True,
    )
    + "SELECT rule_id, symbol, type, ts, close FROM fd WHERE hit AND NOT was",
)
def stream_alerts(spark, d):
    facts = scored_daily(spark, d).select("symbol", "ts", F.col("rsi_value").alias("rsi"), "confidence", "verdict", "passes", "stage", "cross")
    snaps = facts.join(P.type_px(spark, d).select("symbol", "ts", "close"), ["symbol", "ts"])
    stream = ST.stream_alerts(_as_stream(spark, snaps, "snapshots"), _as_stream(spark, alert_changes(spark, d), "rules"))
    return keyed(spark, stream, "stream_alerts")


SESS = """WITH o AS (SELECT event_type AS symbol, ts, value, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM o),
a AS (SELECT symbol, min(ts) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS "end", count(*) AS trades, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM g GROUP BY symbol, s)
SELECT * FROM a"""


@query("session_bars", "P7", SESS)
def session_bars(spark, d):
    return J.session_bars(P.event_trades(spark, d))


@query("stream_session_bars", "P7", SESS + ' WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR')
def stream_session_bars(spark, d):
    return spark.read.parquet(J.run_to_table(J.session_bars(J.read_trades(spark, d)), "stream_sessions"))
