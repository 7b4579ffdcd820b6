"""Levels, breaks of levels and their path rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as L
from ..operators import study as S
from ..functions import windows as w
from . import panels as P
from .indicators import STEP_SQL, WS, full
from .registry import query
from .regimes import AGE
from .studies import CAL, long_sql, summary_sql

PX = P.px_sql("brand")


def piv(k: int, c: str = "high") -> str:
    a = f"OVER ({WS} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    b = f"OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    return f"coalesce(count({c}) {a} = {k} AND count({c}) {b} = {k} AND {c} > max({c}) {a} AND {c} > max({c}) {b}, false)"


PV = f"pv AS MATERIALIZED (SELECT *, {piv(3)} AS piv FROM ag)"
LV = "lv AS MATERIALIZED (SELECT *, max(high) FILTER (age BETWEEN 1 AND 50) OVER (PARTITION BY symbol) AS level FROM pv)"
TOUCH = "piv AND age BETWEEN 4 AND 47 AND abs(high - level) / level <= 0.015"


@query("swing_touches", "D23", P.with_(PX, AGE, PV, LV) + f"SELECT symbol, max(level) AS level, count(*) FILTER ({TOUCH}) AS touches FROM lv GROUP BY symbol")
def swing_touches(spark, d):
    return L.swing_touches(P.brand_px(spark, d))


@query(
    "confirmed_pivots",
    "D24",
    P.with_(PX, f"c AS (SELECT *, CASE WHEN {piv(5)} THEN high END AS p FROM px)", f"k AS (SELECT symbol, ts, lag(p, 5) OVER ({WS}) AS pv FROM c)")
    + 'SELECT symbol, ts, pv AS "pivot" FROM k WHERE pv IS NOT NULL',
)
def confirmed_pivots(spark, d):
    return L.confirmed_pivots(P.brand_px(spark, d)).where("pivot IS NOT NULL").select("symbol", "ts", "pivot")


BUCKET = """CASE {} ELSE '>25% below' END""".format(
    " ".join(f"WHEN {{x}} >= {lo} AND {{x}} < {hi} THEN '{lab}'" for lo, hi, lab, _, _ in L.ATH_BY_DISTANCE)
)
BUCKET_P = """CASE {} ELSE 0.08 END""".format(
    " ".join(f"WHEN {{x}} >= {lo} AND {{x}} < {hi} THEN {p}" for lo, hi, _, p, _ in L.ATH_BY_DISTANCE)
)
RES = f"""lh AS MATERIALIZED (SELECT *, max(high) FILTER (age BETWEEN 22 AND 71) OVER (PARTITION BY symbol) AS hold FROM lv),
r0 AS (SELECT symbol, count(*) AS nn, max(close) FILTER (age = 0) AS price, max(close) FILTER (age = 1) AS c1, max(level) AS level, max(high) FILTER (age BETWEEN 2 AND 51) AS level1,
 count(*) FILTER ({TOUCH}) AS touches, max(close) FILTER (age >= 1) AS ath, count(volume) AS nv, max(volume) FILTER (age = 0) AS v, avg(volume) FILTER (age BETWEEN 1 AND 50) AS va,
 CASE WHEN count(*) >= 200 THEN avg(close) FILTER (age < 200) END AS m200, avg((close > coalesce(hold, level))::INT) FILTER (age < 21) AS frac FROM lh GROUP BY symbol),
r1 AS (SELECT *, level / price - 1 AS pct_to_level, ath / price - 1 AS dist_ath, CASE WHEN nv > 50 AND va > 0 THEN v > 1.5 * va END AS volume_surge, price > m200 AS uptrend FROM r0 WHERE nn >= 58),
res AS MATERIALIZED (SELECT symbol, price, level, touches, pct_to_level, CASE WHEN price > level AND NOT c1 > level1 THEN 'fresh_breakout' WHEN price > level AND frac >= 0.6 THEN 'holding_above'
 WHEN price > level THEN 'choppy_above' WHEN pct_to_level <= 0.02 THEN 'approaching' ELSE 'below' END AS state, ath, dist_ath,
 {BUCKET.format(x='dist_ath')} AS ath_bucket, CAST({BUCKET_P.format(x='dist_ath')} AS DOUBLE) AS p_reach_ath_63d, volume_surge, uptrend,
 coalesce(uptrend, false) AND coalesce(volume_surge, false) AND dist_ath < 0.1 AS best_combo FROM r1)"""
RES_CTES = [PX, AGE, PV, LV, RES]


@query("resistance_state", "E10 J6", P.with_(*RES_CTES) + "SELECT * FROM res")
def resistance_state(spark, d):
    return L.resistance_state(P.brand_px(spark, d))


def _ahead(fn: str, h: int) -> str:
    return f"{fn}(close) OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"


FRESH = f"""fb0 AS MATERIALIZED (SELECT *, {full('max', 'high', 50, 1)} AS level, max(close) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_high,
 lag(close) OVER ({WS}) AS c1, coalesce(volume > 1.5 * ({full('avg', 'volume', 50, 1)}), false) AS surge,
 {', '.join(f"{_ahead('count', h)} AS n{h}, {_ahead('max', h)} AS mx{h}, {_ahead('min', h)} AS mn{h}" for h in (5, 21, 63))} FROM px),
fb1 AS (SELECT *, lag(level) OVER ({WS}) AS level1 FROM fb0),
fb AS MATERIALIZED (SELECT symbol, ts, i, n, level, close, prior_high, surge AS volume_surge, CASE WHEN n5 >= 3 THEN mx5 > close END AS pushed_higher_5,
 CASE WHEN n21 >= 12 THEN mn21 < level END AS retest_21, CASE WHEN n21 >= 12 THEN mn21 < 0.97 * level END AS failed_21, n21,
 CASE WHEN n63 >= 35 THEN mx63 >= prior_high END AS reached_high_63 FROM fb1 WHERE close > level AND c1 <= level1 AND i < n - 1),
fh AS MATERIALIZED (SELECT fb.*, CASE WHEN n21 >= 12 THEN (SELECT count(*) FILTER (q.close > fb.level) * 1.0 / count(*) FROM px q
 WHERE q.symbol = fb.symbol AND q.i > fb.i AND q.i <= fb.i + 21) >= 0.8 END AS held_21 FROM fb)"""


@query(
    "fresh_breaks",
    "E11",
    P.with_(PX, FRESH)
    + "SELECT symbol, ts, n, level, close, prior_high, volume_surge, pushed_higher_5, retest_21, failed_21, held_21, reached_high_63 FROM fh",
)
def fresh_breaks(spark, d):
    return L.fresh_breaks(P.brand_px(spark, d))


RATES = ", ".join(f"avg({c}::INT) AS {c}" for c in ("pushed_higher_5", "retest_21", "failed_21", "reached_high_63"))


@query(
    "breakout_track_record",
    "E11",
    P.with_(PX, FRESH) + f"SELECT symbol, count(*) AS events, {RATES} FROM fb WHERE n >= 130 GROUP BY symbol HAVING count(*) >= 8",
)
def breakout_track_record(spark, d):
    return L.breakout_track_record(P.brand_px(spark, d))


@query(
    "breakout_path_rates",
    "F49",
    P.with_(
        PX,
        FRESH,
        f"fc AS (SELECT *, {BUCKET.format(x='prior_high / close - 1')} AS bucket FROM fh)",
        "fu AS (SELECT *, 'all' AS cut FROM fc UNION ALL SELECT *, CASE WHEN volume_surge THEN 'volume' ELSE 'no_volume' END FROM fc UNION ALL SELECT *, 'ath: ' || bucket FROM fc)",
    )
    + "SELECT cut, count(*) AS events, avg(retest_21::INT) AS retest_21, avg(failed_21::INT) AS failed_21, avg(held_21::INT) AS held_21, avg(reached_high_63::INT) AS reached_high_63 FROM fu GROUP BY cut",
)
def breakout_path_rates(spark, d):
    return L.breakout_path_rates(P.brand_px(spark, d))


@query(
    "approach_rates",
    "F49",
    P.with_(
        PX,
        f"a0 AS (SELECT *, {full('max', 'high', 50, 1)} AS level, {_ahead('max', 21)} AS mx, {_ahead('min', 21)} AS mn, {_ahead('count', 21)} AS nx FROM px)",
        "a1 AS (SELECT *, coalesce(close <= level AND level / close - 1 <= 0.02, false) AS inn FROM a0)",
        f"a2 AS (SELECT *, coalesce(lag(inn) OVER ({WS}), false) AS was FROM a1)",
    )
    + "SELECT count(*) AS episodes, avg((mx > level)::INT) AS broke_21, avg((mn < 0.95 * close)::INT) AS fell_5pct_21 FROM a2 WHERE inn AND NOT was AND nx = 21",
)
def approach_rates(spark, d):
    return L.approach_rates(P.brand_px(spark, d))


NEAREST = f"""np0 AS (SELECT *, CASE WHEN {piv(5)} THEN high END AS p FROM px),
np1 AS MATERIALIZED (SELECT *, lag(p, 5) OVER ({WS}) AS pv_, lag(close) OVER ({WS}) AS prev FROM np0),
np2 AS MATERIALIZED (SELECT symbol, i AS known, pv_, lag(pv_) OVER (PARTITION BY symbol ORDER BY i) AS before FROM np1 WHERE pv_ IS NOT NULL),
np3 AS (SELECT b.symbol, b.ts, b.close, b.prev, arg_min({{'p': a.pv_, 'b': a.before}}, (a.pv_, a.known)) AS r FROM np1 b JOIN np2 a ON a.symbol = b.symbol AND a.known < b.i
 AND a.pv_ > b.prev WHERE b.i >= 259 GROUP BY 1, 2, 3, 4),
npb AS MATERIALIZED (SELECT symbol, ts, r.p AS level, coalesce(r.p > r.b, false) AS notable FROM np3 WHERE close > r.p)"""


@query("nearest_pivot_breaks", "D25", P.with_(PX, NEAREST) + "SELECT * FROM npb")
def nearest_pivot_breaks(spark, d):
    return L.nearest_pivot_breaks(P.brand_px(spark, d))


MULTI = f"""mt0 AS MATERIALIZED (SELECT symbol, i, CASE WHEN {piv(3)} THEN high END AS p FROM px),
mt1 AS (SELECT b.symbol, b.ts, b.i, b.close, lag(b.close) OVER (PARTITION BY symbol ORDER BY ts) AS prev, max(b.close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS top FROM px b),
mt2 AS (SELECT t.symbol, t.i, t.ts, t.close, t.prev, t.top, a.p AS anchor, a.i AS ai, count(*) AS c, max(z.p) AS level FROM mt1 t
 JOIN mt0 a ON a.symbol = t.symbol AND a.p IS NOT NULL AND a.i BETWEEN t.i - 117 AND t.i - 4
 JOIN mt0 z ON z.symbol = t.symbol AND z.p IS NOT NULL AND z.i BETWEEN t.i - 117 AND t.i - 4 AND abs(z.p / a.p - 1) <= 0.015
 WHERE t.i >= 123 GROUP BY ALL),
mt3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY c DESC, ai) AS rk FROM mt2),
mtb AS MATERIALIZED (SELECT symbol, ts, level, c AS touches FROM mt3 WHERE rk = 1 AND c >= 3 AND top <= level AND prev <= level AND close > level)"""


@query("multi_touch_breaks", "D26", P.with_(PX, MULTI) + "SELECT * FROM mtb")
def multi_touch_breaks(spark, d):
    return L.multi_touch_breaks(P.brand_px(spark, d))


SHELF = f"""vs0 AS MATERIALIZED (SELECT *, min(low) OVER ({WS} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS lo, max(high) OVER ({WS} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS hi FROM px),
vs1 AS (SELECT symbol, i, close, lo, hi, (hi - lo) / 30 AS wd FROM vs0 WHERE i >= 120 AND (i - 120) % 5 = 0 AND hi > lo),
vs2 AS (SELECT g.symbol, g.i, g.close, b.b, g.lo + g.wd * (b.b + 0.5) AS centre, sum(CASE WHEN s.high > s.low THEN s.volume * greatest(least(g.lo + g.wd * b.b + g.wd, s.high) - greatest(g.lo + g.wd * b.b, s.low), 0) / (s.high - s.low)
  WHEN greatest(least(floor((s.high - g.lo) / g.wd), 29), 0) = b.b THEN s.volume ELSE 0 END) AS v
 FROM vs1 g JOIN px s ON s.symbol = g.symbol AND s.i BETWEEN g.i - 120 AND g.i - 1 CROSS JOIN (SELECT unnest(range(30)) AS b) b GROUP BY ALL),
vs3 AS (SELECT symbol, i, arg_max(centre, (v, -b)) AS r FROM vs2 WHERE centre > close AND v > 0 GROUP BY symbol, i),
vs4 AS MATERIALIZED (SELECT px.symbol, px.ts, px.i, px.close, last_value(r IGNORE NULLS) OVER (PARTITION BY px.symbol ORDER BY px.ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS shelf FROM px LEFT JOIN vs3 ON vs3.symbol = px.symbol AND vs3.i = px.i),
vs5 AS (SELECT *, coalesce(close > shelf, false) AS ab FROM vs4),
vsb AS MATERIALIZED (SELECT symbol, ts, shelf FROM (SELECT *, coalesce(lag(ab) OVER ({WS}), false) AS was, lag(shelf) OVER ({WS}) AS r1 FROM vs5) WHERE ab AND NOT was AND r1 IS NOT NULL AND i >= 124)"""


@query("volume_shelf", "D27", P.with_(PX, SHELF) + "SELECT symbol, ts, shelf FROM vs4 WHERE shelf IS NOT NULL")
def volume_shelf(spark, d):
    return L.volume_shelf(P.brand_px(spark, d)).where("shelf IS NOT NULL").select("symbol", "ts", "shelf")


@query("volume_shelf_breaks", "D27", P.with_(PX, SHELF) + "SELECT * FROM vsb")
def volume_shelf_breaks(spark, d):
    return L.volume_shelf_breaks(P.brand_px(spark, d))


PEAK = f"""pk0 AS (SELECT symbol, ts, close, {full('max', 'high', 126, 126)} AS peak, {full('min', 'low', 126, 1)} AS lowest, lag(close) OVER ({WS}) AS prev, i FROM px),
pkb AS MATERIALIZED (SELECT symbol, ts FROM pk0 WHERE lowest <= 0.9 * peak AND prev <= peak AND prev >= 0.97 * peak AND close > peak AND i >= 299)"""
ROUND = f"""rn0 AS (SELECT *, lag(close) OVER ({WS}) AS prev FROM px),
rn1 AS (SELECT *, CAST({STEP_SQL.format(p='prev')} AS DOUBLE) AS step FROM rn0 WHERE prev IS NOT NULL OR i = 0),
rn2 AS (SELECT *, CASE WHEN prev IS NOT NULL THEN floor(prev / step) * step + step END AS r FROM rn1),
rn3 AS (SELECT *, coalesce(close < r AND (r - close) / r <= 0.04, false)::INT AS u FROM rn2),
rn4 AS (SELECT *, {full('sum', 'u', 20, 1)} AS stuck FROM rn3),
rnb AS MATERIALIZED (SELECT symbol, ts FROM rn4 WHERE stuck >= 10 AND prev < r AND close > r AND i >= 24)"""


@query("prior_peak_retest", "D28", P.with_(PX, PEAK) + "SELECT * FROM pkb")
def prior_peak_retest(spark, d):
    x = P.brand_px(spark, d).withColumn("m", L.prior_peak_retest())
    return x.where("m").select("symbol", "ts")


@query("round_number_break", "D29", P.with_(PX, ROUND) + "SELECT * FROM rnb")
def round_number_break(spark, d):
    return L.with_round_number_break(P.brand_px(spark, d)).where("round_break").select("symbol", "ts")


LEVEL_SRC = """lm AS MATERIALIZED (SELECT px.*, mtb.symbol IS NOT NULL AS multi_touch, npb.symbol IS NOT NULL AS swinghigh_basic, coalesce(npb.notable, false) AS swinghigh_notable,
 pkb.symbol IS NOT NULL AS prior_peak, rnb.symbol IS NOT NULL AS round_break, vsb.symbol IS NOT NULL AS volume_shelf FROM px LEFT JOIN mtb USING (symbol, ts) LEFT JOIN npb USING (symbol, ts)
 LEFT JOIN pkb USING (symbol, ts) LEFT JOIN rnb USING (symbol, ts) LEFT JOIN vsb USING (symbol, ts))"""


@query(
    "level_studies",
    "F20",
    P.with_(PX, NEAREST, MULTI, SHELF, PEAK, ROUND, LEVEL_SRC, *long_sql(L.LEVEL_MASKS, (5, 21, 63), "lm", masks={m: m for m in L.LEVEL_MASKS}))
    + summary_sql(),
)
def level_studies(spark, d):
    x = L.with_level_masks(P.brand_px(spark, d))
    return S.run_study(x, {m: w.flag(F.col(m)) for m in L.LEVEL_MASKS}, (5, 21, 63))
