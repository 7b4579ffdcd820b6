"""Regime reads on the newest bar of every symbol."""

from __future__ import annotations

from ..operators import regimes as R
from . import panels as P
from .indicators import RSI_WILDER_SQL, WS, full, gains, numbered, recur
from .registry import query

PX = P.px_sql("brand")
AGE = "ag AS MATERIALIZED (SELECT *, n - 1 - i AS age FROM px)"


def tail(fn: str, n: int, c: str = "close", shift: int = 0) -> str:
    f = f"FILTER (age BETWEEN {shift} AND {shift + n - 1})"
    return f"CASE WHEN count({c}) {f} >= {n} THEN {fn}({c}) {f} END"


def at(age: int, c: str = "close") -> str:
    return f"max({c}) FILTER (age = {age})"


HORIZON_SQL = "\nUNION ALL ".join(
    f"""SELECT symbol, '{lab}' AS label, CAST({b} AS BIGINT) AS bars, {at(0)} / {at(b)} - 1 AS change,
 100 * regr_slope(close, i) / avg(close) AS slope_pct_per_bar FROM ag WHERE age <= {b} GROUP BY symbol HAVING count(*) > {b}"""
    for lab, b in R.HORIZONS
)
DIR = "CASE WHEN slope_pct_per_bar > 0.05 THEN 'uptrend' WHEN slope_pct_per_bar < -0.05 THEN 'downtrend' ELSE 'sideways' END"
MTF = [AGE, f"mtf AS (SELECT *, {DIR} AS direction FROM ({HORIZON_SQL}))"]
ALIGN = """al AS (SELECT symbol, count(*) FILTER (direction = 'uptrend') AS ups, count(*) FILTER (direction = 'downtrend') AS downs, count(*) AS horizons,
 CASE WHEN count(*) FILTER (direction = 'uptrend') = count(*) THEN 'strong_up' WHEN count(*) FILTER (direction = 'downtrend') = count(*) THEN 'strong_down'
 WHEN count(*) FILTER (direction = 'uptrend') > count(*) FILTER (direction = 'downtrend') THEN 'mostly_up'
 WHEN count(*) FILTER (direction = 'uptrend') < count(*) FILTER (direction = 'downtrend') THEN 'mostly_down' ELSE 'mixed' END AS alignment FROM mtf GROUP BY symbol)"""


@query("multi_timeframe", "E1", P.with_(PX, *MTF) + "SELECT * FROM mtf")
def multi_timeframe(spark, d):
    return R.multi_timeframe(P.brand_px(spark, d))


@query("timeframe_alignment", "E1", P.with_(PX, *MTF, ALIGN) + "SELECT * FROM al")
def timeframe_alignment(spark, d):
    return R.alignment(R.multi_timeframe(P.brand_px(spark, d)))


REGIME = f"""reg AS (SELECT symbol, ts, price, sma50, sma200, price > sma50 AS above_sma50, price > sma200 AS above_sma200,
 CASE WHEN sma50 > sma200 THEN 'golden' WHEN sma200 IS NOT NULL THEN 'death' END AS cross FROM (
 SELECT symbol, ts, close AS price, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200, age FROM ag) WHERE age = 0)"""


@query(
    "ma_regime",
    "A1 A2 A5 B3 E2",
    P.with_(P.bars_sql("type"), "ag AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS age FROM bars)", REGIME)
    + "SELECT * FROM reg",
)
def ma_regime(spark, d):
    return R.ma_regime(P.type_bars(spark, d))


BENCH = f"""{P.px_sql('type', 'tpx')},
mk AS MATERIALIZED (SELECT ts, avg(close) AS bench FROM tpx GROUP BY ts),
br AS MATERIALIZED (SELECT ag.*, bench FROM ag ASOF LEFT JOIN mk ON ag.ts >= mk.ts)"""
RS_SQL = f"""rstr AS (SELECT symbol, stock_ret, bench_ret, stock_ret - bench_ret AS excess, stock_ret > bench_ret AS outperforming,
 least(1.0, greatest(-1.0, (stock_ret - bench_ret) / 0.2)) AS value FROM (
 SELECT symbol, {at(0)} / {at(125)} - 1 AS stock_ret, {at(0, 'bench')} / {at(125, 'bench')} - 1 AS bench_ret FROM br
 GROUP BY symbol HAVING count(close) FILTER (age <= 126) = 127 AND count(bench) FILTER (age <= 126) = 127))"""


@query("relative_strength", "E6 J2", P.with_(PX, AGE, BENCH, RS_SQL) + "SELECT * FROM rstr")
def relative_strength(spark, d):
    return R.relative_strength(P.brand_px(spark, d), P.market(P.type_px(spark, d)))


TEMPLATE = f"""tt0 AS (SELECT symbol, count(*) AS bars, {at(0)} AS p, {tail('avg', 50)} AS m50, {tail('avg', 150)} AS m150, {tail('avg', 200)} AS m200,
 {tail('avg', 200, shift=22)} AS m200p, {tail('min', 252)} AS lo, {tail('max', 252)} AS hi, {at(0)} / {at(251)} - 1 AS yr FROM ag GROUP BY symbol),
tt1 AS (SELECT tt0.*, bars >= 252 AS available, coalesce(rstr.excess, yr) AS stg FROM tt0 LEFT JOIN rstr USING (symbol)),
tt2 AS (SELECT *, p > m150 AND p > m200 AS c1, m150 > m200 AS c2, m200 > m200p AS c3, m50 > m150 AND m50 > m200 AS c4, p > m50 AS c5, p >= 1.3 * lo AS c6,
 p >= 0.75 * hi AS c7, stg > 0 AS c8 FROM tt1),
tt3 AS (SELECT *, CAST(c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT + c7::INT + c8::INT AS BIGINT) AS score FROM tt2),
tmpl AS MATERIALIZED (SELECT symbol, available, c1, c2, c3, c4, c5, c6, c7, c8, score, score = 8 AS passes, CAST(CASE
 WHEN score >= 7 AND c1 AND c2 AND c4 AND c5 THEN 2 WHEN score <= 2 AND p < m200 THEN 4 WHEN p < m200 AND m50 > m150 THEN 1 ELSE 3 END AS BIGINT) AS stage FROM tt3)"""


@query("trend_template", "E3 E4", P.with_(PX, AGE, BENCH, RS_SQL, TEMPLATE) + "SELECT * FROM tmpl")
def trend_template(spark, d):
    px = P.brand_px(spark, d)
    return R.trend_template(px, R.relative_strength(px, P.market(P.type_px(spark, d))))


STAGE = f"""st AS (SELECT symbol, price, sma50, sma200, slope200, CASE WHEN price > sma200 AND slope200 > 0.005 THEN 'stage2' WHEN price > sma200 THEN 'stage3'
 WHEN price > sma50 THEN 'recovering' WHEN slope200 < -0.005 THEN 'stage4' ELSE 'stage1' END AS stage FROM (
 SELECT symbol, {at(0)} AS price, {tail('avg', 50)} AS sma50, {tail('avg', 200)} AS sma200, ({tail('avg', 200)}) / ({tail('avg', 200, shift=21)}) - 1 AS slope200
 FROM ag GROUP BY symbol) WHERE slope200 IS NOT NULL)"""


@query("trend_stage", "E5", P.with_(PX, AGE, STAGE) + "SELECT * FROM st")
def trend_stage(spark, d):
    return R.trend_stage(P.brand_px(spark, d))


EXT = f"""ex AS MATERIALIZED (SELECT *, close / ({full('avg', 'close', 50)}) - 1 AS e FROM ag),
exs AS (SELECT symbol, ext, percentile_2y, recent_max_ext, CASE WHEN ext >= 0.25 THEN 'blowoff' WHEN ext >= 0.15 THEN 'extended'
 WHEN abs(ext) <= 0.02 AND recent_max_ext >= 0.15 THEN 'ma_touch_after_run' WHEN ext <= -0.15 THEN 'stretched_below' ELSE 'normal' END AS state FROM (
 SELECT symbol, count(*) AS nn, max(e) FILTER (age = 0) AS ext, max(e) FILTER (age < 63) AS recent_max_ext,
  CASE WHEN count(e) FILTER (age < 504) > 100 THEN 100.0 * count(*) FILTER (age < 504 AND e <= now) / count(e) FILTER (age < 504) END AS percentile_2y
 FROM (SELECT *, max(CASE WHEN age = 0 THEN e END) OVER (PARTITION BY symbol) AS now FROM ex) GROUP BY symbol) WHERE nn >= 120 AND ext IS NOT NULL)"""


@query("extension_state", "E7", P.with_(PX, AGE, EXT) + "SELECT * FROM exs")
def extension_state(spark, d):
    return R.extension_state(P.brand_px(spark, d))


GAPS = f"""gp AS MATERIALIZED (SELECT *, open / lag(close) OVER ({WS}) - 1 AS gap, close / open - 1 AS o2c, lag(close) OVER ({WS}) AS pc, open AS op FROM ag),
gd AS MATERIALIZED (SELECT *, CASE WHEN gap >= 0.005 THEN 'up' WHEN gap <= -0.005 THEN 'down' END AS direction, CASE WHEN abs(gap) >= 0.02 THEN 'big' ELSE 'small' END AS size,
 CASE WHEN gap >= 0.005 THEN close > op WHEN gap <= -0.005 THEN close < op END AS cont, CASE WHEN gap >= 0.005 THEN low <= pc WHEN gap <= -0.005 THEN high >= pc END AS fade FROM gp),
gs AS MATERIALIZED (SELECT symbol, direction, bucket, count(*) AS n, avg(cont::INT) AS continued_rate, avg(fade::INT) AS faded_rate, avg(o2c) AS avg_open_to_close
 FROM (SELECT *, size AS bucket FROM gd UNION ALL SELECT *, 'all' FROM gd) WHERE age >= 1 AND direction IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10)"""


@query("gap_stats", "E8 K3", P.with_(PX, AGE, GAPS) + "SELECT * FROM gs")
def gap_stats(spark, d):
    return R.gap_stats(P.brand_px(spark, d))


@query(
    "gap_today",
    "E9",
    P.with_(PX, AGE, GAPS)
    + """SELECT g.symbol, g.gap, g.direction IS NOT NULL AS gapped_today, g.direction, CASE WHEN g.direction IS NOT NULL THEN g.size END AS bucket,
 coalesce(s.n, a.n) AS n, coalesce(s.continued_rate, a.continued_rate) AS continued_rate, coalesce(s.faded_rate, a.faded_rate) AS faded_rate,
 coalesce(s.avg_open_to_close, a.avg_open_to_close) AS avg_open_to_close FROM gd g
 LEFT JOIN gs s ON s.symbol = g.symbol AND s.direction = g.direction AND s.bucket = g.size
 LEFT JOIN gs a ON a.symbol = g.symbol AND a.direction = g.direction AND a.bucket = 'all'
 WHERE g.age = 0 AND g.n >= 121 AND g.symbol IN (SELECT symbol FROM gs)""",
)
def gap_today(spark, d):
    return R.gap_today(P.brand_px(spark, d))


RSI_CTES = [
    numbered(PX, "px"),
    recur(gains(14), first="k = 2"),
    f"ri AS MATERIALIZED (SELECT b.*, n - 1 - i AS age, {RSI_WILDER_SQL.format(p=14)} AS rsi FROM b LEFT JOIN e USING (symbol, k))",
]
WATCH = f"""bw0 AS (SELECT symbol, count(*) AS nn, count(close) FILTER (age BETWEEN 6 AND 30) AS nb, {at(0)} AS p, {at(1)} AS c1, {at(5)} AS c5,
 max(close) FILTER (age BETWEEN 6 AND 30) AS level, min(close) FILTER (age BETWEEN 6 AND 30) AS lo, {at(0, 'rsi')} AS rsi, {tail('avg', 200)} AS m200
 FROM ri GROUP BY symbol),
bw1 AS (SELECT *, (level - lo) / level <= 0.15 AND p > level AND c5 <= level AS broke, (level - lo) / level <= 0.15 AND p <= level AND (level - p) / level <= 0.04 AS coil FROM bw0),
bwt AS (SELECT symbol, level, CASE WHEN broke THEN 'broke' ELSE 'coiling' END AS status, broke AND c1 <= level AS fresh, p / level - 1 AS dist,
 coalesce(rsi >= 68, false) AS overbought, m200 > p AS overhead_200, p / m200 - 1 AS dist_200 FROM bw1 WHERE nb >= 20 AND nn >= 210 AND (broke OR coil))"""


@query("breakout_watch", "E14", P.with_(*RSI_CTES, WATCH, recursive=True) + "SELECT * FROM bwt")
def breakout_watch(spark, d):
    return R.breakout_watch(P.brand_px(spark, d))


XPAIRS = [("macro", "e89 - e204"), ("fast", "e55 - e89"), ("zero", "m"), ("signal", "m - sg")]
CROSS_CTES = [
    numbered(PX, "px"),
    recur({"e55": ("close", "2.0/56"), "e89": ("close", "2.0/90"), "e204": ("close", "2.0/205"), "ef": ("close", "2.0/14"), "es": ("close", "2.0/35")}),
    "ml AS MATERIALIZED (SELECT symbol, k, ef - es AS m FROM e)",
    recur({"sg": ("m", "2.0/10")}, src="ml", name="s"),
    "xa AS MATERIALIZED (SELECT b.symbol, b.ts, b.close, n - 1 - i AS age, n, e55, e89, e204, m, sg, "
    + ", ".join(f"sign({x}) AS s_{nm}, lag(sign({x})) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS p_{nm}" for nm, x in XPAIRS)
    + " FROM b JOIN e USING (symbol, k) JOIN ml USING (symbol, k) JOIN s USING (symbol, k))",
    "xg AS (SELECT symbol, max(n) AS nn, "
    + ", ".join(f"max({c}) FILTER (age = 0) AS {a}" for c, a in (("close", "price"), ("e55", "e55"), ("e89", "e89"), ("e204", "e204"), ("m", "macd"), ("sg", "macd_signal")))
    + ", "
    + ", ".join(
        f"min(age) FILTER (s_{nm} <> 0 AND p_{nm} <> 0 AND s_{nm} <> p_{nm} AND age < 90) AS {nm}_bars_ago, "
        f"arg_min(s_{nm}, age) FILTER (s_{nm} <> 0 AND p_{nm} <> 0 AND s_{nm} <> p_{nm} AND age < 90) AS d_{nm}"
        for nm, _ in XPAIRS
    )
    + " FROM xa GROUP BY symbol)",
    """cro AS MATERIALIZED (SELECT symbol, price, e55, e89, e204, macd, macd_signal,
 CASE WHEN e55 > e89 AND e89 > e204 AND macd > 0 AND price > e55 THEN 'buy' WHEN e55 < e89 AND e89 < e204 AND NOT macd > 0 AND NOT price > e55 THEN 'sell' ELSE 'neutral' END AS state,
 CASE WHEN e55 > e89 AND e89 > e204 AND macd > 0 AND price > e55 THEN 'up' WHEN e55 < e89 AND e89 < e204 AND NOT macd > 0 AND NOT price > e55 THEN 'down' END AS direction,
 CAST((e55 > e89 AND e89 > e204)::INT + (macd > 0)::INT + (price > e55)::INT AS BIGINT) AS conditions_met, """
    + ", ".join(f"CASE WHEN d_{nm} > 0 THEN 'up' WHEN d_{nm} < 0 THEN 'down' END AS {nm}_cross, {nm}_bars_ago" for nm, _ in XPAIRS)
    + " FROM xg WHERE nn >= 209)",
]


@query("crossover_system", "E12", P.with_(*CROSS_CTES, recursive=True) + "SELECT * FROM cro")
def crossover_system(spark, d):
    return R.crossover_system(P.brand_px(spark, d))
