"""Swing extrema, level clusters and chart patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as PT
from . import panels as P
from .indicators import WS
from .registry import query

PX = P.px_sql("type")
CHART = "ch AS MATERIALIZED (SELECT symbol, ts, close, i AS x, n AS nn FROM px)"
_A = f"OVER ({WS} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_B = f"OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
EXT = f"""ext AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, x, nn, close AS price, CASE WHEN count(*) {_A} = 5 AND count(*) {_B} = 5 THEN
 CASE WHEN close > max(close) {_A} AND close > max(close) {_B} THEN 'high' WHEN close < min(close) {_A} AND close < min(close) {_B} THEN 'low' END END AS kind FROM ch) WHERE kind IS NOT NULL)"""


@query("swing_extrema", "D17", P.with_(PX, CHART, EXT) + "SELECT symbol, ts, x, kind, price FROM ext")
def swing_extrema(spark, d):
    return PT.swing_extrema(PT.chart_tail(P.type_px(spark, d))).select("symbol", "ts", "x", "kind", "price")


LEVELS = [
    "hd AS (SELECT symbol, arg_max(close, ts) AS price, 0.02 * (max(close) - min(close)) AS tol FROM ch GROUP BY symbol)",
    "sw AS MATERIALIZED (SELECT e.symbol, e.price AS p, tol, row_number() OVER (PARTITION BY e.symbol ORDER BY e.price) AS k FROM ext e JOIN hd USING (symbol))",
    """cl AS (SELECT symbol, k, 1 AS c, p AS s, 1 AS m, p FROM sw WHERE k = 1 UNION ALL SELECT q.symbol, q.k, CASE WHEN abs(q.p - z.s / z.m) <= q.tol THEN z.c ELSE z.c + 1 END,
 CASE WHEN abs(q.p - z.s / z.m) <= q.tol THEN z.s + q.p ELSE q.p END, CASE WHEN abs(q.p - z.s / z.m) <= q.tol THEN z.m + 1 ELSE 1 END, q.p FROM cl z JOIN sw q ON q.symbol = z.symbol AND q.k = z.k + 1)""",
    "lv AS (SELECT symbol, c, avg(p) AS level, count(*) AS touches FROM cl GROUP BY 1, 2)",
    """sr AS MATERIALIZED (SELECT symbol, kind, pos, level, touches FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY abs(level - price), level) AS pos FROM (
 SELECT lv.*, price, CASE WHEN level > price THEN 'resistance' WHEN level < price THEN 'support' END AS kind FROM lv JOIN hd USING (symbol)) WHERE kind IS NOT NULL) WHERE pos <= 4)""",
]


@query("support_resistance", "D18", P.with_(PX, CHART, EXT, *LEVELS, recursive=True) + "SELECT * FROM sr")
def support_resistance(spark, d):
    return PT.support_resistance(P.type_px(spark, d))


REV = [
    "tl AS (SELECT symbol, 0.03 * (max(close) - min(close)) AS tol FROM ch GROUP BY symbol)",
    """nx AS MATERIALIZED (SELECT e.*, tol, lead(price) OVER k AS p1, lead(price, 2) OVER k AS p2, lead(ts) OVER k AS t1, lead(ts, 2) OVER k AS t2, lead(x) OVER k AS x1
 FROM ext e JOIN tl USING (symbol) WINDOW k AS (PARTITION BY symbol, kind ORDER BY x))""",
    """bt AS (SELECT a.symbol, a.kind, a.x, min(b.price) AS lo, max(b.price) AS hi FROM nx a JOIN ext b ON b.symbol = a.symbol AND b.kind <> a.kind AND b.x > a.x AND b.x < a.x1 GROUP BY 1, 2, 3)""",
    """rev AS MATERIALIZED (SELECT nx.symbol, 'Double Top' AS name, 'bearish' AS bias, nx.ts AS lo, t1 AS hi, 0 AS rk, x FROM nx JOIN bt USING (symbol, kind, x) WHERE kind = 'high' AND abs(price - p1) <= tol AND bt.lo < least(price, p1) - tol
 UNION ALL SELECT nx.symbol, 'Double Bottom', 'bullish', nx.ts, t1, 1, x FROM nx JOIN bt USING (symbol, kind, x) WHERE kind = 'low' AND abs(price - p1) <= tol AND bt.hi > greatest(price, p1) + tol
 UNION ALL SELECT symbol, 'Head & Shoulders', 'bearish', ts, t2, 2, x FROM nx WHERE kind = 'high' AND p1 > price AND p1 > p2 AND abs(price - p2) <= 1.5 * tol
 UNION ALL SELECT symbol, 'Inverse Head & Shoulders', 'bullish', ts, t2, 3, x FROM nx WHERE kind = 'low' AND p1 < price AND p1 < p2 AND abs(price - p2) <= 1.5 * tol)""",
]


@query("reversal_patterns", "D19 D20 J9", P.with_(PX, CHART, EXT, *REV) + "SELECT symbol, name, bias, lo, hi FROM rev")
def reversal_patterns(spark, d):
    return PT.reversals(P.type_px(spark, d)).select("symbol", "name", "bias", "lo", "hi")


TRI = """tg AS (SELECT e.symbol, count(*) FILTER (kind = 'high') AS nh, count(*) FILTER (kind = 'low') AS nl, regr_slope(price, x) FILTER (kind = 'high') AS sh, regr_slope(price, x) FILTER (kind = 'low') AS sl
 FROM ext e WHERE x >= floor(nn * 0.55) GROUP BY 1),
tm AS (SELECT symbol, avg(close) AS m FROM ch WHERE x >= floor(nn * 0.55) GROUP BY 1),
tri AS (SELECT symbol, 100 * sh / m AS slope_high, 100 * sl / m AS slope_low FROM tg JOIN tm USING (symbol) WHERE nh >= 3 AND nl >= 3)"""
PXB = P.px_sql("brand")


@query(
    "triangles",
    "D21",
    P.with_(PXB, CHART, EXT, TRI)
    + """SELECT *, CASE name WHEN 'Ascending Triangle' THEN 'bullish' WHEN 'Descending Triangle' THEN 'bearish' ELSE 'neutral' END AS bias FROM (SELECT *,
 CASE WHEN abs(slope_high) < 0.03 AND slope_low > 0.03 THEN 'Ascending Triangle' WHEN slope_high < -0.03 AND abs(slope_low) < 0.03 THEN 'Descending Triangle'
 WHEN slope_high < -0.03 AND slope_low > 0.03 THEN 'Symmetrical Triangle' END AS name FROM tri) WHERE name IS NOT NULL""",
)
def triangles(spark, d):
    return PT.triangles(P.brand_px(spark, d)).select("symbol", "name", "bias", "slope_high", "slope_low")


NAMED = """SELECT symbol, slope_high, slope_low, name, CASE name WHEN 'Ascending Triangle' THEN 'bullish' WHEN 'Descending Triangle' THEN 'bearish' ELSE 'neutral' END AS bias FROM (SELECT *,
 CASE WHEN abs(slope_high) < 0.03 AND slope_low > 0.03 THEN 'Ascending Triangle' WHEN slope_high < -0.03 AND abs(slope_low) < 0.03 THEN 'Descending Triangle'
 WHEN slope_high < -0.03 AND slope_low > 0.03 THEN 'Symmetrical Triangle' END AS name FROM tri) WHERE name IS NOT NULL"""
#: Newest first, a reversal is kept if it ends before all kept ones begin; ``pat`` has the numbered patterns.
PATTERNS = [
    *REV,
    "ro AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hi DESC, rk, x) AS k FROM rev)",
    """kp AS (SELECT symbol, k, lo AS m, true AS t, 1 AS c FROM ro WHERE k = 1 UNION ALL SELECT q.symbol, q.k, CASE WHEN q.hi < z.m THEN least(z.m, q.lo) ELSE z.m END, q.hi < z.m,
 CASE WHEN q.hi < z.m THEN z.c + 1 ELSE z.c END FROM kp z JOIN ro q ON q.symbol = z.symbol AND q.k = z.k + 1)""",
    TRI,
    f"tn AS ({NAMED})",
    "te AS (SELECT symbol, arg_min(ts, x) AS lo, arg_max(ts, x) AS hi FROM ext WHERE x >= floor(nn * 0.55) GROUP BY 1)",
    """pat AS MATERIALIZED (SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY hi DESC, rk, x) AS pos, name, bias, lo AS start_ts, hi AS end_ts FROM (
 SELECT symbol, name, bias, lo, hi, rk, x FROM ro JOIN kp USING (symbol, k) WHERE t AND c <= 5 UNION ALL SELECT symbol, name, bias, lo, hi, 9, 0 FROM tn JOIN te USING (symbol))) WHERE pos <= 6)""",
]


@query("chart_patterns", "D22", P.with_(PXB, CHART, EXT, *PATTERNS, recursive=True) + "SELECT * FROM pat")
def chart_patterns(spark, d):
    return PT.chart_patterns(P.brand_px(spark, d)).select("symbol", "pos", "name", "bias", "start_ts", "end_ts")


@query(
    "pattern_staleness",
    "E29",
    P.with_(PXB, CHART, EXT, *PATTERNS, recursive=True)
    + """SELECT symbol, pos, name, bias, age_days, age_days > 21 * 1.5 AS stale FROM (SELECT pat.*, date_diff('day', CAST(end_ts AS DATE), CAST(now AS DATE)) AS age_days
 FROM pat JOIN (SELECT symbol, max(ts) AS now FROM px GROUP BY symbol) USING (symbol))""",
)
def pattern_staleness(spark, d):
    px = P.brand_px(spark, d)
    return PT.staleness(PT.chart_patterns(px), px)
