"""Trade replays, strategies and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tradeplan as TP
from ..operators import trades as TR
from . import panels as P
from .indicators import RSI_EWM_SQL, WS, full, gains, numbered, recur
from .registry import query
from .volatility import FIX, vol_ctes

PX = P.px_sql("type")
_DIP_BARS = [
    recur(gains(2), first="k = 2", name="r2e"),
    f"tb AS MATERIALIZED (SELECT b.*, {RSI_EWM_SQL.format(p=2)} AS rsi2, {full('avg', 'close', 5)} AS sma5, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200 FROM b LEFT JOIN r2e USING (symbol, k))",
    "dp AS MATERIALIZED (SELECT *, coalesce(rsi2 < 15 AND close > sma200 AND i >= 210, false) AS dip FROM tb)",
]
BASE = [numbered(PX, "px"), *_DIP_BARS]


def walk(entry: str, name: str) -> list[str]:
    """Bar-by-bar replay as a recursion: state (in trade, entry price, entry bar)."""
    return [
        f"{name}s AS MATERIALIZED (SELECT symbol, i, close, sma5, coalesce(lag({entry}) OVER ({WS}), false) AS go FROM dp)",
        f"""{name}w AS (SELECT symbol, i, false AS held, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS BIGINT) AS ei, CAST(NULL AS DOUBLE) AS ret FROM {name}s WHERE i = 210
 UNION ALL SELECT q.symbol, q.i, CASE WHEN NOT p.held THEN q.go ELSE NOT (q.close > q.sma5 OR q.close / p.ep - 1 >= 0.06 OR q.close / p.ep - 1 <= -0.08 OR q.i - p.ei >= 12) END,
  CASE WHEN NOT p.held THEN q.close ELSE p.ep END, CASE WHEN NOT p.held THEN q.i ELSE p.ei END,
  CASE WHEN p.held AND (q.close > q.sma5 OR q.close / p.ep - 1 >= 0.06 OR q.close / p.ep - 1 <= -0.08 OR q.i - p.ei >= 12) THEN q.close / p.ep - 1 END
 FROM {name}w p JOIN {name}s q ON q.symbol = p.symbol AND q.i = p.i + 1)""",
        f"{name} AS MATERIALIZED (SELECT symbol, ei AS i, i - ei AS held, ret FROM {name}w WHERE ret IS NOT NULL)",
    ]


RAND = """dp2 AS (SELECT *, i >= 210 AND i < n - 1 AS ok, count(*) FILTER (dip) OVER (PARTITION BY symbol) AS want, md5(symbol || '|' || strftime(ts, '%Y-%m-%d') || '|0') AS h FROM dp),
dp3 AS MATERIALIZED (SELECT *, ok AND row_number() OVER (PARTITION BY symbol, ok ORDER BY h) <= want AS pick FROM dp2)"""
DIP = [*BASE, *walk("dip", "dt")]
#: ``dst`` is the dip state of each symbol of ``px``, numbered as ``b``.
DIP_STATE = [
    *_DIP_BARS,
    *walk("dip", "dt"),
    "dto AS (SELECT symbol, avg((ret > 0)::INT) AS win_rate FROM dt GROUP BY symbol HAVING count(*) >= 15)",
    "dst AS MATERIALIZED (SELECT symbol, coalesce(close > sma200, false) AS dip_up, coalesce(rsi2 < 15 AND close > sma200, false) AS dip_active, win_rate FROM dp JOIN dto USING (symbol) WHERE i = n - 1 AND n >= 260)",
]
BOTH = [*DIP, RAND, *[c.replace("FROM dp)", "FROM dp3)") for c in walk("pick", "rt")]]


@query("dip_trades", "F7", P.with_(*DIP, recursive=True) + "SELECT symbol, i, held, ret FROM dt")
def dip_trades(spark, d):
    return TR.dip_trades(P.type_px(spark, d))


METRIC = """count(*) AS n, avg((ret > 0)::INT) AS win_rate, avg(ret) AS avg_ret,
 CASE WHEN sum(ret) FILTER (ret <= 0) < 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret <= 0) END AS profit_factor"""


@query("trade_metrics", "F9", P.with_(*DIP, recursive=True) + f"SELECT symbol, {METRIC} FROM dt GROUP BY symbol")
def trade_metrics(spark, d):
    return TR.trade_metrics(TR.dip_trades(P.type_px(spark, d)), ["symbol"])


@query("random_entry_control", "F10", P.with_(*BOTH, recursive=True) + "SELECT symbol, i, held, ret FROM rt")
def random_entry_control(spark, d):
    return TR.random_entry_control(P.type_px(spark, d))


@query(
    "entry_edge",
    "F11",
    P.with_(
        *BOTH,
        "g AS (SELECT count(*) FILTER (d) AS n_rule, avg((ret > 0)::INT) FILTER (d) AS win_rule, avg(ret) FILTER (d) AS avg_rule, count(*) FILTER (NOT d) AS n_random, "
        "avg((ret > 0)::INT) FILTER (NOT d) AS win_random, avg(ret) FILTER (NOT d) AS avg_random FROM (SELECT true AS d, ret FROM dt UNION ALL SELECT false, ret FROM rt))",
        "h AS (SELECT *, (win_rule * n_rule + win_random * n_random) / (n_rule + n_random) AS pp FROM g)",
        recursive=True,
    )
    + "SELECT * EXCLUDE pp, (win_rule - win_random) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / n_rule + 1.0::DOUBLE / n_random)) AS z FROM h",
)
def entry_edge(spark, d):
    return TR.entry_edge(P.type_px(spark, d))


@query(
    "dip_state",
    "E13",
    P.with_(
        *DIP,
        "own AS (SELECT symbol, count(*) AS n_trades, avg((ret > 0)::INT) AS win_rate, avg(ret) AS avg_per_trade, coalesce(quantile_cont(ret, 0.5) FILTER (ret > 0), 0.02) AS typical_bounce FROM dt GROUP BY symbol HAVING count(*) >= 15)",
        "now AS (SELECT symbol, close AS price, rsi2, coalesce(close > sma200, false) AS in_uptrend, coalesce(rsi2 < 15 AND close > sma200, false) AS active FROM dp WHERE i = n - 1 AND n >= 260)",
        recursive=True,
    )
    + "SELECT symbol, price, rsi2, active, in_uptrend, n_trades, win_rate, avg_per_trade, typical_bounce, CASE WHEN active THEN price * (1 + typical_bounce) END AS target, CASE WHEN active THEN price * 0.92 END AS stop FROM now JOIN own USING (symbol)",
)
def dip_state(spark, d):
    return TR.dip_state(P.type_px(spark, d))


POS = """{n} AS (SELECT symbol, i, 0 AS {n}_pos FROM sg WHERE i = 0 UNION ALL SELECT q.symbol, q.i,
 CASE WHEN p.{n}_pos = 0 AND q.{n}_e THEN 1 WHEN p.{n}_pos = 1 AND q.{n}_x THEN 0 ELSE p.{n}_pos END FROM {n} p JOIN sg q ON q.symbol = p.symbol AND q.i = p.i + 1)"""
LAB = [
    *BASE,
    f"sg0 AS (SELECT *, close > {{hi}} AS che, close < {{lo}} AS chx FROM (SELECT *, {full('max', 'close', 50, 1)} AS hi50, {full('min', 'close', 50, 1)} AS lo50 FROM tb))".replace("{hi}", "hi50").replace("{lo}", "lo50"),
    f"""sg AS MATERIALIZED (SELECT *, close / lag(close) OVER w - 1 AS r, coalesce(lag(che) OVER w, false) AS ch_e, coalesce(lag(chx) OVER w, false) AS ch_x,
 coalesce(lag(rsi2 < 10 AND close > sma200) OVER w, false) AS rd_e, coalesce(lag(close > sma5) OVER w, false) AS rd_x,
 coalesce(lag(close > sma200) OVER w, false)::INT AS f200, coalesce(lag(sma50 > sma200) OVER w, false)::INT AS gold FROM sg0 WINDOW w AS ({WS}))""",
    POS.format(n="ch"),
    POS.format(n="rd"),
    "st AS MATERIALIZED (SELECT sg.symbol, sg.ts, sg.i, sg.n, r, 1 AS hold, f200 AS filter200, gold AS golden, ch_pos AS channel, rd_pos AS rsi2_dip FROM sg JOIN ch USING (symbol, i) JOIN rd USING (symbol, i))",
]
RULES = "hold, filter200, golden, channel, rsi2_dip"
EQ = """eq AS (SELECT *, product(1 + coalesce(sr, 0)) OVER (PARTITION BY symbol, rule ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM lng),
dw AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, rule ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq),
es AS (SELECT symbol, rule, arg_max(eq, ts) - 1 AS total_return, min(dd) AS max_drawdown, avg(coalesce(sr, 0)) / (stddev_samp(coalesce(sr, 0)) + 1e-12) * sqrt(252) AS sharpe,
 avg(CAST(pos AS DOUBLE)) AS exposure, stddev_samp(sr) * sqrt(252) AS annual_vol FROM dw GROUP BY 1, 2)"""


@query("position_walk", "F8", P.with_(*LAB, recursive=True) + "SELECT symbol, ts, CAST(channel AS DOUBLE) AS channel, CAST(rsi2_dip AS DOUBLE) AS rsi2_dip FROM st")
def position_walk(spark, d):
    return TR.strategy_states(P.type_px(spark, d)).select("symbol", "ts", "channel", "rsi2_dip")


@query(
    "strategy_lab",
    "F6",
    P.with_(*LAB, f"lng AS (SELECT *, r * pos AS sr FROM (SELECT symbol, ts, r, {RULES} FROM st WHERE n - i <= 504 AND n >= 260) UNPIVOT (pos FOR rule IN ({RULES})))", EQ, recursive=True)
    + """SELECT e.symbol, e.rule, e.total_return, e.max_drawdown, e.sharpe, e.exposure, CASE WHEN e.rule = 'hold' THEN 'benchmark'
 WHEN e.total_return > h.total_return AND e.max_drawdown > h.max_drawdown + 0.02 THEN 'beats_both' WHEN e.sharpe > h.sharpe + 0.05 AND e.max_drawdown > h.max_drawdown + 0.02 THEN 'better_risk_adjusted'
 WHEN e.max_drawdown > h.max_drawdown + 0.02 AND NOT e.total_return > h.total_return THEN 'safer' WHEN e.total_return > h.total_return THEN 'higher_return' ELSE 'loses' END AS verdict
 FROM es e JOIN es h ON h.symbol = e.symbol AND h.rule = 'hold'""",
)
def strategy_lab(spark, d):
    return TR.strategy_lab(P.type_px(spark, d), 504)


@query(
    "timing_study",
    "F27",
    P.with_(*LAB, "lng AS (SELECT *, r * pos AS sr FROM (SELECT symbol, ts, r, hold, filter200 FROM st WHERE r IS NOT NULL) UNPIVOT (pos FOR rule IN (hold, filter200)))", EQ, recursive=True)
    + "SELECT symbol, rule, total_return, max_drawdown, sharpe, exposure, annual_vol FROM es",
)
def timing_study(spark, d):
    return TR.timing_study(P.type_px(spark, d))


def excursion_ctes(h: int, px: str = PX) -> list[str]:
    f = f"OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return [
        *[FIX(c) for c in vol_ctes(px, "px")],
        f"""xc AS MATERIALIZED (SELECT symbol, ts, i, n, close, sigma, CASE WHEN count(*) {f} = {h} THEN max(high) {f} / close - 1 END AS mfe,
 CASE WHEN count(*) {f} = {h} THEN min(low) {f} / close - 1 END AS mae, lead(close, {h}) OVER ({WS}) / close - 1 AS er, sigma * sqrt({h}) AS sh FROM vols)""",
    ]


LEVELS = """least(2 * med, greatest(0.5 * med, raw)) AS nw, raw / med AS vr"""
OUT = """safe * nw AS target_ret, stretch * nw AS stretch_ret, stp * nw AS stop_ret, entry * (1 + safe * nw) AS target, entry * (1 + stretch * nw) AS stretch, entry * (1 + stp * nw) AS stop,
 vr AS vol_ratio, nw AS weekly_vol, CASE WHEN vr > 1.25 THEN 'elevated' WHEN vr < 0.8 THEN 'calm' ELSE 'normal' END AS regime"""


def plan_ctes(h: int, px: str = PX) -> list[str]:
    s = f"FILTER (n - 1 - i BETWEEN {h} AND {h + 251} AND sh > 0)"
    return [
        *excursion_ctes(h, px),
        f"""pl0 AS (SELECT symbol, max(n) AS nn, count(mfe) {s} AS samples, max(close) FILTER (i = n - 1) AS entry, arg_max(sh, ts) FILTER (sh IS NOT NULL) AS raw, quantile_cont(sh, 0.5::DOUBLE) {s} AS med,
 quantile_cont(mfe / sh, 0.34::DOUBLE) {s} AS safe, quantile_cont(mfe / sh, 0.5::DOUBLE) {s} AS stretch, quantile_cont(mae / sh, 0.34::DOUBLE) {s} AS stp,
 avg((mfe > 0)::INT) {s} AS p_profit_intraperiod, avg((er > 0)::INT) {s} AS p_profit_at_close FROM xc GROUP BY symbol)""",
        f"plan AS MATERIALIZED (SELECT symbol, entry, samples, p_profit_intraperiod, p_profit_at_close, {OUT.replace('stretch * nw', 'st2 * nw')} FROM (SELECT * EXCLUDE stretch, stretch AS st2, {LEVELS} FROM pl0 WHERE nn >= {h + 80} AND samples >= 40))",
    ]


@query("trade_plan", "E17 S7", P.with_(*plan_ctes(5), recursive=True) + "SELECT * FROM plan")
def trade_plan(spark, d):
    return TP.trade_plan(P.type_px(spark, d))


@query("trade_plan_month", "E17", P.with_(*plan_ctes(21), recursive=True) + "SELECT * FROM plan")
def trade_plan_month(spark, d):
    return TP.trade_plan(P.type_px(spark, d), 21)


SERIES = [
    *excursion_ctes(5),
    "an AS (SELECT symbol, ts, i, close AS entry, sh AS raw, mfe AS amfe FROM xc WHERE i >= 300 AND (i - 300) % 3 = 0 AND sh > 0)",
    """ap AS (SELECT a.symbol, a.ts, a.i, a.entry, a.raw, a.amfe, count(*) AS c, quantile_cont(s.sh, 0.5::DOUBLE) AS med, quantile_cont(s.mfe / s.sh, 0.34::DOUBLE) AS safe
 FROM an a JOIN xc s ON s.symbol = a.symbol AND s.i BETWEEN a.i - 256 AND a.i - 5 AND s.sh > 0 GROUP BY ALL HAVING count(*) >= 40)""",
    "cb AS (SELECT *, safe * least(2 * med, greatest(0.5 * med, raw)) AS tr FROM ap WHERE amfe IS NOT NULL)",
]


@query(
    "target_calibration",
    "F42",
    P.with_(*SERIES, recursive=True)
    + "SELECT symbol, count(*) AS n, avg(tr) AS avg_target, avg((amfe >= tr)::INT) AS target_hit, avg((amfe >= 0.03)::INT) AS fixed_hit, avg((amfe > 0)::INT) AS p_green FROM cb GROUP BY symbol",
)
def target_calibration(spark, d):
    return TP.target_calibration(P.type_px(spark, d))
