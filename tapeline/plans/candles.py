"""Candlestick and volume signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles as C
from ..operators import volume as VOL
from . import panels as P
from .indicators import OBV_CTE, WS, full, partial
from .registry import query

PX = P.px_sql("type")


def geometry_cte(src: str = "px") -> str:
    return f"""geo AS MATERIALIZED (SELECT *, close - open AS body, abs(close - open) AS a, greatest(high - low, 1e-9) AS rng,
 high - greatest(open, close) AS up, least(open, close) - low AS lo, coalesce(sign(lag(close, 1) OVER w - lag(close, 5) OVER w), 0) AS tr,
 lag(open, 1) OVER w AS o1, lag(close, 1) OVER w AS c1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2,
 lag(close - open, 1) OVER w AS b1, lag(close - open, 2) OVER w AS b2,
 lag(abs(close - open), 1) OVER w AS a1, lag(abs(close - open), 2) OVER w AS a2,
 lag((open + close) / 2, 1) OVER w AS m1, lag((open + close) / 2, 2) OVER w AS m2
 FROM {src} WINDOW w AS ({WS}))"""


_TAIL = "a <= 0.4 * rng AND a > 0"
_RULES = [
    ("Doji", "neutral", "a <= 0.1 * rng", "0.4 + 0.6 * (1 - a / (0.1 * rng))"),
    ("Bullish Marubozu", "bullish", "up < 0.05 * rng AND lo < 0.05 * rng AND a > 0.6 * rng AND body > 0", "0.6 + 0.4 * (1 - (up + lo) / (0.1 * rng))"),
    ("Bearish Marubozu", "bearish", "up < 0.05 * rng AND lo < 0.05 * rng AND a > 0.6 * rng AND body < 0", "0.6 + 0.4 * (1 - (up + lo) / (0.1 * rng))"),
    ("Hammer", "bullish", f"lo >= 2 * a AND up <= 0.3 * a + 0.05 * rng AND {_TAIL} AND tr < 0", "0.4 + 0.15 * (lo / (a + 1e-9) - 2)"),
    ("Hanging Man", "bearish", f"lo >= 2 * a AND up <= 0.3 * a + 0.05 * rng AND {_TAIL} AND tr > 0", "0.4 + 0.15 * (lo / (a + 1e-9) - 2)"),
    ("Inverted Hammer", "bullish", f"up >= 2 * a AND lo <= 0.3 * a + 0.05 * rng AND {_TAIL} AND tr < 0", "0.4 + 0.15 * (up / (a + 1e-9) - 2)"),
    ("Shooting Star", "bearish", f"up >= 2 * a AND lo <= 0.3 * a + 0.05 * rng AND {_TAIL} AND tr > 0", "0.4 + 0.15 * (up / (a + 1e-9) - 2)"),
    ("Bullish Engulfing", "bullish", "b1 < 0 AND body > 0 AND open <= c1 AND close >= o1 AND a > a1", "0.5 + 0.5 * least((a - a1) / (a1 + 1e-9), 1)"),
    ("Bearish Engulfing", "bearish", "b1 > 0 AND body < 0 AND open >= c1 AND close <= o1 AND a > a1", "0.5 + 0.5 * least((a - a1) / (a1 + 1e-9), 1)"),
    ("Bullish Harami", "bullish", "b1 < 0 AND body > 0 AND a < a1 AND open >= c1 AND close <= o1", "0.4 + 0.5 * (1 - a / (a1 + 1e-9))"),
    ("Bearish Harami", "bearish", "b1 > 0 AND body < 0 AND a < a1 AND open <= c1 AND close >= o1", "0.4 + 0.5 * (1 - a / (a1 + 1e-9))"),
    ("Piercing Line", "bullish", "b1 < 0 AND body > 0 AND open <= c1 AND close > m1 AND close < o1", "0.5 + 0.4 * least((close - m1) / (a1 / 2 + 1e-9), 1)"),
    ("Dark Cloud Cover", "bearish", "b1 > 0 AND body < 0 AND open >= c1 AND close < m1 AND close > o1", "0.5 + 0.4 * least((m1 - close) / (a1 / 2 + 1e-9), 1)"),
    ("Morning Star", "bullish", "b2 < 0 AND a1 < 0.5 * a2 AND body > 0 AND a > 0.5 * a2 AND close > m2", "0.55 + 0.4 * least((close - m2) / (a2 / 2 + 1e-9), 1)"),
    ("Evening Star", "bearish", "b2 > 0 AND a1 < 0.5 * a2 AND body < 0 AND a > 0.5 * a2 AND close < m2", "0.55 + 0.4 * least((m2 - close) / (a2 / 2 + 1e-9), 1)"),
    ("Three White Soldiers", "bullish", "b2 > 0 AND b1 > 0 AND body > 0 AND c1 > c2 AND close > c1 AND o2 < o1 AND o1 < c2 AND o1 < open AND open < c1", "0.7"),
    ("Three Black Crows", "bearish", "b2 < 0 AND b1 < 0 AND body < 0 AND c1 < c2 AND close < c1 AND c2 < o1 AND o1 < o2 AND c1 < open AND open < o1", "0.7"),
]


def events_cte(name: str = "cev") -> str:
    parts = [
        f"SELECT symbol, ts, i, n, close, CAST({k} AS INTEGER) AS rank, '{nm}' AS name, '{b}' AS bias, greatest(0.3, least(1.0, {s})) AS strength "
        f"FROM geo WHERE {c}"
        for k, (nm, b, c, s) in enumerate(_RULES)
    ]
    return f"{name} AS MATERIALIZED (" + "\n UNION ALL ".join(parts) + ")"


@query(
    "candle_events",
    "D1 D2 D3 D4 D5 D6 D7 D8 D9 D10 D11",
    P.with_(PX, geometry_cte(), events_cte()) + "SELECT symbol, ts, name, bias, strength FROM cev",
)
def candle_events(spark, d):
    return C.events(P.type_px(spark, d)).select("symbol", "ts", "name", "bias", "strength")


@query(
    "candle_geometry",
    "D1 D2",
    P.with_(PX, geometry_cte()) + 'SELECT symbol, ts, body, a AS size, rng, up AS upper, lo AS lower, CAST(tr AS DOUBLE) AS trend FROM geo',
)
def candle_geometry(spark, d):
    return C.geometry(P.type_px(spark, d)).select("symbol", "ts", "body", "size", "rng", "upper", "lower", "trend")


@query(
    "candles_recent",
    "D12 K9",
    P.with_(PX, geometry_cte(), events_cte())
    + """SELECT symbol, ts, name, bias, strength, pos FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, rank) AS pos
 FROM cev WHERE n - i <= 40) WHERE pos <= 12""",
)
def candles_recent(spark, d):
    return C.detect(P.type_px(spark, d)).select("symbol", "ts", "name", "bias", "strength", F.col("pos").cast("long").alias("pos"))


def volume_ctes(src: str = "px") -> list[str]:
    return [
        f"""vb AS MATERIALIZED (SELECT *, {partial('avg', 'volume', 50, 20)} AS a50, {partial('avg', 'volume', 5, 3)} AS a5,
 {full('max', 'close', 20)} AS hi20, {full('min', 'close', 20)} AS lo20, coalesce(close > lag(close) OVER ({WS}), false) AS upd FROM {src})""",
        """vev AS MATERIALIZED (
 SELECT symbol, ts, i, n, 0 AS rank, 'Volume Spike' AS name, CASE WHEN upd THEN 'bullish' ELSE 'bearish' END AS bias,
   least(greatest((volume / a50 - 2) / 2 + 0.5, 0), 1) AS strength FROM vb WHERE a50 > 0 AND volume / a50 >= 2
 UNION ALL SELECT symbol, ts, i, n, 1, 'Breakout on Volume', 'bullish', least((volume / a50 - 1.5) / 2.5 + 0.5, 1.0) FROM vb
   WHERE a50 > 0 AND volume / a50 >= 1.5 AND close >= hi20
 UNION ALL SELECT symbol, ts, i, n, 2, 'Breakdown on Volume', 'bearish', least((volume / a50 - 1.5) / 2.5 + 0.5, 1.0) FROM vb
   WHERE a50 > 0 AND volume / a50 >= 1.5 AND close <= lo20 AND NOT close >= hi20
 UNION ALL SELECT symbol, ts, i, n, 3, 'Volume Dry-Up', 'neutral', least(greatest(1 - a5 / a50, 0), 1) FROM vb WHERE a50 > 0 AND a5 <= 0.5 * a50)""",
        """vrec AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, rank) AS pos FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol, name ORDER BY ts DESC) AS nth FROM vev WHERE n - i <= 40)
   WHERE name <> 'Volume Dry-Up' OR nth <= 2) WHERE pos <= 10)""",
    ]


@query(
    "volume_signals",
    "D13 D14 D15",
    P.with_(PX, *volume_ctes()) + "SELECT symbol, ts, name, bias, strength, pos FROM vrec",
)
def volume_signals(spark, d):
    return VOL.detect(P.type_px(spark, d)).select(
        "symbol", "ts", "name", "bias", "strength", F.col("pos").cast("long").alias("pos")
    )


@query(
    "volume_events_full",
    "D13 D14",
    P.with_(PX, *volume_ctes()) + "SELECT symbol, ts, name, bias, strength FROM vev WHERE name <> 'Volume Dry-Up'",
)
def volume_events_full(spark, d):
    return VOL.events(P.type_px(spark, d), None).where("name <> 'Volume Dry-Up'").select("symbol", "ts", "name", "bias", "strength")


@query(
    "volume_analysis",
    "D16",
    P.with_(
        PX,
        *volume_ctes(),
        OBV_CTE.replace("FROM bars", "FROM px"),
        "t AS (SELECT symbol, regr_slope(obv, i) / avg(abs(obv)) AS s FROM ob WHERE n - i <= 20 GROUP BY symbol)",
    )
    + """SELECT v.symbol, sum(volume) <> 0 AS available, max(CASE WHEN i = n - 1 AND a50 > 0 THEN volume / a50 END) AS latest_ratio,
 any_value(CASE WHEN t.s > 0.01 THEN 'rising' WHEN t.s < -0.01 THEN 'falling' ELSE 'flat' END) AS obv_trend,
 coalesce(any_value(r.c), 0) AS n_signals FROM vb v JOIN t ON t.symbol = v.symbol
 LEFT JOIN (SELECT symbol, count(*) AS c FROM vrec GROUP BY symbol) r ON r.symbol = v.symbol GROUP BY v.symbol""",
)
def volume_analysis(spark, d):
    return VOL.analysis(P.type_px(spark, d))
