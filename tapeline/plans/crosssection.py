"""Sector, peer and same-date studies on the brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosssection as X
from ..operators import indicators as I
from ..operators import masks as M
from . import panels as P
from .indicators import RSI_WILDER_SQL, WS, full, gains, recur
from .registry import query
from .regimes import AGE, GAPS
from .studies import CAL, F1, FEAT_RSI, features

PX = P.px_sql("brand")
SEC_SQL = f"""sx AS MATERIALIZED (SELECT px.*, 'S' || (CAST(substr(symbol, 7) AS INTEGER) % 3) AS sector, close / lag(close) OVER ({WS}) - 1 AS r1, close / lag(close, 5) OVER ({WS}) - 1 AS r5,
 close / lag(close, 21) OVER ({WS}) - 1 AS r21, lead(close, 5) OVER ({WS}) / close - 1 AS fwd_5, lead(close, 21) OVER ({WS}) / close - 1 AS fwd_21 FROM px)"""


def sector_px(spark, d):
    sector = F.concat(F.lit("S"), F.substring("symbol", 7, 9).cast("int") % 3)
    return P.brand_px(spark, d).withColumn("sector", sector)


PULSE = """pu AS MATERIALIZED (SELECT *, CASE WHEN frac_down >= 0.6 THEN 'broad_selloff' WHEN frac_up >= 0.6 THEN 'broad_rally' END AS event FROM (
 SELECT symbol, sector, ts, r1, r21, count(*) OVER d AS n_members, avg((r1 < -0.01)::INT) OVER d AS frac_down, avg((r1 > 0.01)::INT) OVER d AS frac_up, avg(r1) OVER d AS sector_today,
 avg(r5) OVER d AS sector_r5, avg(r21) OVER d AS sector_r21 FROM sx WHERE r1 IS NOT NULL AND i >= 24 WINDOW d AS (PARTITION BY sector, ts))
 JOIN (SELECT sector, count(DISTINCT symbol) AS size FROM sx GROUP BY 1) USING (sector) WHERE n_members >= greatest(4, size // 2))"""

# Every member with a return on its day; ``available`` has the rules that PULSE filters by.
PULSE_ALL = """pu AS MATERIALIZED (SELECT *, old AND n_old >= greatest(4, size // 2) AS available, CASE WHEN frac_down >= 0.6 THEN 'broad_selloff' WHEN frac_up >= 0.6 THEN 'broad_rally' END AS event FROM (
 SELECT symbol, sector, ts, r1, r21, i >= 24 AS old, count(*) FILTER (i >= 24) OVER d AS n_old, count(*) OVER d AS n_members, avg((r1 < -0.01)::INT) OVER d AS frac_down, avg((r1 > 0.01)::INT) OVER d AS frac_up,
 avg(r1) OVER d AS sector_today, avg(r5) OVER d AS sector_r5, avg(r21) OVER d AS sector_r21 FROM sx WHERE r1 IS NOT NULL WINDOW d AS (PARTITION BY sector, ts)) p
 JOIN (SELECT sector AS sec, count(DISTINCT symbol) AS size FROM sx GROUP BY 1) ON sector IS NOT DISTINCT FROM sec WHERE n_members >= 4)"""


@query(
    "sector_pulse",
    "E18",
    P.with_(PX, SEC_SQL, PULSE_ALL)
    + "SELECT symbol, sector, ts, r1, n_members, frac_down, frac_up, sector_today, sector_r5, sector_r21, event, coalesce(event = 'broad_selloff' AND r1 > 0, false) AS survivor, r21 - sector_r21 AS gap21, available FROM pu",
)
def sector_pulse(spark, d):
    return X.sector_pulse(sector_px(spark, d), broad=0.6, every=True).select(
        "symbol", "sector", "ts", "r1", "n_members", "frac_down", "frac_up", "sector_today", "sector_r5", "sector_r21", "event", "survivor", "gap21", "available"
    )


@query(
    "move_attribution",
    "E19 J8",
    P.with_(
        PX,
        SEC_SQL,
        "nw AS (SELECT symbol, sector, r1 FROM sx WHERE i = n - 1 AND n >= 25)",
        "mv AS (SELECT * FROM nw WHERE abs(r1) >= 0.01 AND sector IN (SELECT sector FROM sx GROUP BY 1 HAVING count(DISTINCT ts) FILTER (n >= 25) >= 40))",
        "cc AS (SELECT a.symbol, b.symbol AS peer, corr(a.r1, b.r1) AS c FROM sx a JOIN sx b ON a.n >= 25 AND b.n >= 25 AND a.sector = b.sector AND a.ts = b.ts AND a.symbol <> b.symbol WHERE a.symbol IN (SELECT symbol FROM mv) GROUP BY 1, 2)",
        "tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, peer) AS k FROM cc) WHERE k <= 3)",
        "g AS (SELECT tp.symbol, avg(nw.r1) AS peer_move, string_agg(peer, ',' ORDER BY peer) AS peers FROM tp JOIN nw ON nw.symbol = tp.peer GROUP BY 1)",
    )
    + """SELECT symbol, r1 AS move, peers, peer_move, r1 - peer_move AS residual, CASE WHEN abs(peer_move) < 0.01 AND abs(r1 - peer_move) >= 0.02 THEN 'stock_specific'
 WHEN sign(peer_move) = sign(r1) AND abs(peer_move) >= 0.5 * abs(r1) THEN 'group_move' END AS attribution FROM mv JOIN g USING (symbol)""",
)
def move_attribution(spark, d):
    return X.move_attribution(sector_px(spark, d), big=0.01)


EVENTS = [
    "sz AS (SELECT sector, count(DISTINCT symbol) AS size FROM sx GROUP BY 1)",
    """ec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ts) AS k FROM (SELECT sector, ts FROM sx JOIN sz USING (sector) GROUP BY sector, ts, size
 HAVING size >= 5 AND count(*) FILTER (r1 < -0.01) * 1.0 / size >= 0.4 AND count(r1) * 1.0 / size > 0.5))""",
    """ek AS (SELECT sector, ts, k, ts AS last, true AS keep FROM ec WHERE k = 1 UNION ALL SELECT q.sector, q.ts, q.k, CASE WHEN date_diff('day', p.last, q.ts) > 30 THEN q.ts ELSE p.last END,
 date_diff('day', p.last, q.ts) > 30 FROM ek p JOIN ec q ON q.sector = p.sector AND q.k = p.k + 1)""",
    "ev AS MATERIALIZED (SELECT sector, ts FROM ek WHERE keep)",
]
KW = dict(share=0.4, coverage=0.5)


@query(
    "sector_event_study",
    "F30",
    P.with_(
        PX,
        SEC_SQL,
        *EVENTS,
        """se AS (SELECT 5::BIGINT AS horizon, ev.sector, ev.ts, avg(sx.fwd_5) FILTER (sx.sector = ev.sector) AS s, avg(sx.fwd_5) AS m FROM ev JOIN sx USING (ts) GROUP BY 1, 2, 3
 UNION ALL SELECT 21, ev.sector, ev.ts, avg(sx.fwd_21) FILTER (sx.sector = ev.sector), avg(sx.fwd_21) FROM ev JOIN sx USING (ts) GROUP BY 1, 2, 3)""".replace("ev JOIN sx USING (ts)", "ev JOIN sx ON ev.ts = sx.ts"),
        recursive=True,
    )
    + "SELECT sector, horizon, count(*) AS n, avg(s) AS sector_fwd, avg(s - m) AS vs_market, avg(s - m) / (stddev_samp(s - m) / sqrt(count(*))) AS t FROM se WHERE s IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8",
)
def sector_event_study(spark, d):
    return X.sector_event_study(sector_px(spark, d), **KW)


@query(
    "survivor_study",
    "F31 J7",
    P.with_(PX, SEC_SQL, *EVENTS, "a AS (SELECT sx.*, ev.ts IS NOT NULL AND r1 > 0 AS alive FROM sx LEFT JOIN ev ON ev.sector = sx.sector AND ev.ts = sx.ts WHERE fwd_5 IS NOT NULL)", recursive=True)
    + "SELECT count(*) FILTER (alive) AS n_survivors, avg(fwd_5) FILTER (alive) AS survivor_fwd, avg((fwd_5 > 0)::INT) FILTER (alive) AS survivor_win, count(*) AS n_all, avg(fwd_5) AS all_fwd, avg((fwd_5 > 0)::INT) AS all_win FROM a",
)
def survivor_study(spark, d):
    return X.survivor_study(sector_px(spark, d), **KW)


@query(
    "laggard_catchup",
    "F32",
    P.with_(
        PX,
        SEC_SQL,
        CAL,
        "lc AS (SELECT sx.*, count(*) OVER d AS nn, r21 - avg(r21) OVER d AS rel, fwd_21 - avg(fwd_21) OVER d AS frel FROM sx JOIN cal USING (ts) WHERE ci >= 252 AND (ci - 252) % 21 = 0 AND r21 IS NOT NULL WINDOW d AS (PARTITION BY sector, ts))",
        "ld AS (SELECT *, row_number() OVER (PARTITION BY sector, ts ORDER BY rel, symbol) AS lo, row_number() OVER (PARTITION BY sector, ts ORDER BY rel DESC, symbol) AS hi FROM lc WHERE nn >= 5)",
        "lv AS (SELECT avg(frel) FILTER (lo <= 2) - avg(frel) FILTER (hi <= 2) AS v FROM ld GROUP BY sector, ts)",
    )
    + "SELECT avg(v) AS mean_diff, avg(v) / (stddev_samp(v) / sqrt(count(v))) AS t, count(v) AS n FROM lv",
)
def laggard_catchup(spark, d):
    return X.laggard_catchup(sector_px(spark, d))


@query(
    "lead_lag",
    "F33",
    P.with_(
        PX,
        SEC_SQL,
        CAL,
        "dy AS (SELECT ts, avg(r1) FILTER (sector = 'S0') AS a, avg(r1) FILTER (sector = 'S1') AS b FROM sx WHERE sector IN ('S0', 'S1') GROUP BY ts)",
        "wn AS (SELECT ci // 21 AS win, sum(a) AS a, sum(b) AS b FROM dy JOIN cal USING (ts) GROUP BY 1)",
        "wx AS (SELECT *, lead(b) OVER (ORDER BY win) AS nb, (SELECT quantile_cont(a, 0.5::DOUBLE) FROM wn) AS med FROM wn)",
    )
    + "SELECT count(*) AS windows, corr(a, b) AS same_corr, corr(a, nb) AS lead_corr, avg(nb) FILTER (a > med) - avg(nb) FILTER (NOT a > med) AS hi_lo FROM wx",
)
def lead_lag(spark, d):
    return X.lead_lag(sector_px(spark, d), "S0", "S1")


RUNUP = [
    f"ru0 AS (SELECT *, {full('avg', 'volume', 50, 1)} AS va, lag(close) OVER ({WS}) / lag(close, 11) OVER ({WS}) - 1 AS runup, lead(close, 21) OVER ({WS}) / close - 1 AS post FROM px)",
    "ru1 AS MATERIALIZED (SELECT symbol, ts, i, runup, post, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM ru0 WHERE volume > 1.5 * va AND i > 11 AND i + 22 < n)",
    "ru2 AS (SELECT symbol, k, i AS last, true AS keep FROM ru1 WHERE k = 1 UNION ALL SELECT q.symbol, q.k, CASE WHEN q.i - p.last > 40 THEN q.i ELSE p.last END, q.i - p.last > 40 FROM ru2 p JOIN ru1 q ON q.symbol = p.symbol AND q.k = p.k + 1)",
    "ru AS MATERIALIZED (SELECT ru1.* FROM ru1 JOIN ru2 USING (symbol, k) WHERE keep)",
]


@query("runup_events", "F34", P.with_(PX, *RUNUP, recursive=True) + "SELECT symbol, ts, runup, post FROM ru")
def runup_events(spark, d):
    return X.runup_events(P.brand_px(spark, d), spike=1.5)


@query(
    "runup_event_study",
    "F34 F12",
    P.with_(
        PX,
        *RUNUP,
        "q AS (SELECT quantile_cont(runup, 0.7::DOUBLE) AS q7, quantile_cont(runup, 0.3::DOUBLE) AS q3 FROM ru)",
        "s AS (SELECT count(*) AS n, avg(post) FILTER (runup >= q7) AS m1, var_samp(post) FILTER (runup >= q7) AS v1, count(*) FILTER (runup >= q7) AS n1, avg(post) FILTER (runup <= q3) AS m2, var_samp(post) FILTER (runup <= q3) AS v2, count(*) FILTER (runup <= q3) AS n2 FROM ru, q)",
        recursive=True,
    )
    + "SELECT n, m1 AS big_runup, m2 AS weak_runup, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t FROM s",
)
def runup_event_study(spark, d):
    return X.runup_event_study(P.brand_px(spark, d), spike=1.5)


def twin_pairs(spark, d):
    """Twins of the panel: each odd brand number with the next one."""
    b = P.brand_px(spark, d).select("symbol").distinct().withColumn("k", F.substring("symbol", 7, 9).cast("int"))
    return b.where("k % 2 = 1").select(F.col("symbol").alias("a"), F.concat(F.lit("Brand#"), (F.col("k") + 1).cast("string")).alias("b"))


@query(
    "twin_divergence",
    "F35",
    P.with_(
        PX,
        SEC_SQL,
        "pr AS (SELECT DISTINCT symbol AS a, 'Brand#' || (CAST(substr(symbol, 7) AS INTEGER) + 1) AS b FROM px WHERE CAST(substr(symbol, 7) AS INTEGER) % 2 = 1)",
        "bo AS (SELECT a AS hit, b AS other FROM pr UNION ALL SELECT b, a FROM pr)",
        "tw AS (SELECT o.fwd_5 AS f FROM sx h JOIN bo ON bo.hit = h.symbol JOIN sx o ON o.symbol = bo.other AND o.ts = h.ts WHERE h.r1 < -0.025 AND o.r1 >= -0.025 AND o.fwd_5 IS NOT NULL)",
    )
    + "SELECT 'untouched_twin' AS grp, count(*) AS n, avg(f) AS mean_fwd, avg((f > 0)::INT) AS win_rate FROM tw UNION ALL SELECT 'all', count(fwd_5), avg(fwd_5), avg((fwd_5 > 0)::INT) FILTER (fwd_5 IS NOT NULL) FROM sx",
)
def twin_divergence(spark, d):
    return X.twin_divergence(P.brand_px(spark, d), twin_pairs(spark, d))


@query(
    "bellwether_crash",
    "F35",
    P.with_(PX, SEC_SQL, "mk AS (SELECT ts, avg(r1) AS mkt FROM sx WHERE r1 IS NOT NULL GROUP BY ts)", "mn AS (SELECT *, lead(mkt) OVER (ORDER BY ts) AS nxt FROM mk)")
    + "SELECT symbol, count(*) AS n, avg(mkt) AS same_day, avg(nxt) AS next_day FROM sx JOIN mn USING (ts) WHERE r1 <= -0.03 GROUP BY 1 UNION ALL SELECT '(any day)', count(*), avg(mkt), avg(nxt) FROM mn",
)
def bellwether_crash(spark, d):
    return X.bellwether_crash(P.brand_px(spark, d), 0.03)


@query(
    "momentum_spread",
    "F25 K5",
    P.with_(
        PX,
        CAL,
        f"mo AS (SELECT *, close / lag(close, 126) OVER ({WS}) - 1 AS mom6, lead(close, 21) OVER ({WS}) / close - 1 AS f21, lead(close, 63) OVER ({WS}) / close - 1 AS f63 FROM px JOIN cal USING (ts))",
        """ml AS (SELECT 21::BIGINT AS horizon, ts, mom6, f21 AS f FROM mo WHERE mom6 IS NOT NULL AND ci >= 260 AND ci < cn - 21 AND (ci - 260) % 21 = 0
 UNION ALL SELECT 63, ts, mom6, f63 FROM mo WHERE mom6 IS NOT NULL AND ci >= 260 AND ci < cn - 63 AND (ci - 260) % 63 = 0)""",
        "mq AS (SELECT horizon, ts, quantile_cont(mom6, 2.0::DOUBLE / 3) AS hi, quantile_cont(mom6, 1.0::DOUBLE / 3) AS lo FROM ml GROUP BY 1, 2 HAVING count(*) >= 9)",
        "md AS (SELECT horizon, ts, avg(f) FILTER (mom6 >= hi) - avg(f) FILTER (mom6 <= lo) AS diff FROM ml JOIN mq USING (horizon, ts) GROUP BY 1, 2)",
    )
    + "SELECT horizon, avg(diff) AS top_minus_bottom, avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) AS t, count(diff) AS n_dates FROM md GROUP BY 1",
)
def momentum_spread(spark, d):
    return X.momentum_spread(P.brand_px(spark, d), (21, 63))


SCORE_SQL = """CASE WHEN close > sma200 AND {rs} > 0 AND {rsi} IS NOT NULL THEN least(100 * (0.55 * least(1, greatest(0, (55 - {rsi}) / 30)) + 0.35 * least(1, greatest(0, (sma20 / close - 1) / 0.05)) + 0.1){bonus}, 100.0) ELSE 0.0 END"""


def scored(spark, d):
    def build():
        x = M.with_relative(I.rsi(features(spark, d)), P.market(P.type_px(spark, d)))
        return x.withColumn("score", X.setup_score(F.col("rsi"), F.col("close"), F.col("sma20"), F.col("sma200"), F.col("rs")))

    return P.shared(spark, d, "scored", build)


SCORED = [
    PX,
    F1,
    recur(gains(14), src="f1", first="k = 2", name="we"),
    f"fw AS MATERIALIZED (SELECT f1.*, {RSI_WILDER_SQL.format(p=14)} AS rsi FROM f1 LEFT JOIN we USING (symbol, k))",
    f"""{P.px_sql('type', 'tpx')}""",
    "mk AS (SELECT ts, avg(close) AS bench FROM tpx GROUP BY ts)",
    "fr AS MATERIALIZED (SELECT fw.*, bench FROM fw ASOF LEFT JOIN mk ON fw.ts >= mk.ts)",
    f"fs AS (SELECT *, close / lag(close, 126) OVER ({WS}) - bench / lag(bench, 126) OVER ({WS}) AS rs FROM fr)",
    f"sc AS MATERIALIZED (SELECT *, {SCORE_SQL.format(rs='rs', rsi='rsi', bonus='')} AS score FROM fs)",
]


@query("setup_score", "E15", P.with_(*SCORED, recursive=True) + "SELECT symbol, ts, score FROM sc")
def setup_score(spark, d):
    return scored(spark, d).select("symbol", "ts", "score")


@query(
    "scanner_backtest",
    "F28 F12",
    P.with_(
        *SCORED,
        CAL,
        f"s1 AS (SELECT sc.*, ci, cn, lead(close, 5) OVER ({WS}) / close - 1 AS f5, lead(close, 21) OVER ({WS}) / close - 1 AS f21 FROM sc JOIN cal USING (ts))",
        "s2 AS (SELECT *, count(*) FILTER (score > 0) OVER (PARTITION BY ts) AS nn FROM s1 WHERE ci >= 210 AND ci < cn - 21 AND (ci - 210) % 3 = 0)",
        "s3 AS (SELECT *, score > 0 AND row_number() OVER (PARTITION BY ts, score > 0 ORDER BY score DESC, symbol) <= 5 AS top, score > 0 AND row_number() OVER (PARTITION BY ts, score > 0 ORDER BY score, symbol) <= 5 AS bot FROM s2 WHERE nn >= 6)",
        """s4 AS (SELECT ts, avg(f5) FILTER (top) AS t5, avg(f21) FILTER (top) AS t21, avg(f5) FILTER (bot) AS b5, avg(f21) FILTER (bot) AS b21, avg(f5) AS a5, avg(f21) AS a21 FROM s3 GROUP BY ts)""",
        """s5 AS (SELECT 'top' AS grp, 5::BIGINT AS horizon, t5 AS v, t5 - a5 AS diff FROM s4 UNION ALL SELECT 'top', 21, t21, t21 - a21 FROM s4 UNION ALL SELECT 'bottom', 5, b5, b5 - a5 FROM s4
 UNION ALL SELECT 'bottom', 21, b21, b21 - a21 FROM s4 UNION ALL SELECT 'all', 5, a5, a5 - a5 FROM s4 UNION ALL SELECT 'all', 21, a21, a21 - a21 FROM s4)""",
        recursive=True,
    )
    + "SELECT grp, horizon, count(v) AS n_dates, avg(v) AS mean_fwd, avg((v > 0)::INT) AS win_rate, avg(diff) AS edge, CASE WHEN stddev_samp(diff) > 0 AND count(diff) > 2 THEN avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) END AS paired_t FROM s5 GROUP BY 1, 2",
)
def scanner_backtest(spark, d):
    return X.scanner_backtest(scored(spark, d))


# fixed values: rule names
RULES = {
    "above_200": lambda: F.col("close") > F.col("sma200"),
    "golden_cross": lambda: F.col("sma50") > F.col("sma200"),
    "rsi_below_35": lambda: F.col("rsi14") < 35,
    "rsi_above_55": lambda: F.col("rsi14") > 55,
    "breakout_20": lambda: F.col("close") >= F.col("max20"),
    "hold": lambda: F.lit(True),
}
_R = ["close > sma200", "sma50 > sma200", "rsi14 < 35", "rsi14 > 55", "close >= max20", "true"]


@query(
    "in_out_of_sample",
    "F29 K4",
    P.with_(
        *FEAT_RSI,
        f"io AS MATERIALIZED (SELECT *, CASE WHEN i >= 210 AND i < floor(n * 0.6) THEN 'in' WHEN i >= floor(n * 0.6) AND i < n - 21 THEN 'out' END AS part, coalesce(lead(close, 21) OVER ({WS}) / close - 1 > 0, false)::INT AS win FROM f4)",
        "il AS (" + " UNION ALL ".join(f"SELECT symbol, part, win, '{n}' AS rule, {k} AS ord FROM io WHERE part IS NOT NULL AND {c}" for k, (n, c) in enumerate(zip(RULES, _R))) + ")",
        "ig AS (SELECT symbol, rule, ord, count(*) FILTER (part = 'in') AS ni, avg(win) FILTER (part = 'in') AS wi, count(*) FILTER (part = 'out') AS no, avg(win) FILTER (part = 'out') AS wo FROM il GROUP BY 1, 2, 3)",
        "ib AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY wi DESC, ord) AS k FROM ig WHERE rule <> 'hold' AND ni >= 30)",
        recursive=True,
    )
    + "SELECT b.symbol, b.rule AS best_rule, b.wi AS win_in_sample, CASE WHEN b.no >= 15 THEN b.wo END AS win_out_of_sample, h.wo AS hold_out_of_sample FROM ib b JOIN ig h ON h.symbol = b.symbol AND h.rule = 'hold' WHERE b.k = 1",
)
def in_out_of_sample(spark, d):
    x = features(spark, d, True)
    return X.in_out_of_sample(x, {n: c() for n, c in RULES.items()})


@query(
    "gap_universe",
    "F36",
    P.with_(PX, AGE, GAPS, f"gn AS (SELECT *, lead(close) OVER ({WS}) / close - 1 AS nx FROM gd)")
    + "SELECT direction, size, count(*) AS n, avg(cont::INT) AS continued_rate, avg(fade::INT) AS faded_rate, avg(o2c) AS avg_open_to_close, avg(o2c) / (stddev_samp(o2c) / sqrt(count(o2c))) AS t, avg(nx) AS next_day FROM gn WHERE direction IS NOT NULL GROUP BY 1, 2",
)
def gap_universe(spark, d):
    return X.gap_universe(P.brand_px(spark, d))


EPI = [
    f"e0 AS MATERIALIZED (SELECT *, {full('avg', 'close', 50)} AS ma, lead(close, 63) OVER ({WS}) / close - 1 AS fwd, lead(close, 21) OVER ({WS}) / close - 1 AS fwd21, min(close) OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) / close - 1 AS worst FROM px)",
    "e1 AS MATERIALIZED (SELECT e0.*, lv.level, row_number() OVER (PARTITION BY symbol, level ORDER BY i) AS k FROM e0 JOIN (SELECT unnest([0.05, 0.1])::DOUBLE AS level) lv ON close / ma - 1 >= level WHERE fwd IS NOT NULL)",
    "e2 AS (SELECT symbol, level, k, i AS last, true AS keep FROM e1 WHERE k = 1 UNION ALL SELECT q.symbol, q.level, q.k, CASE WHEN q.i - p.last > 63 THEN q.i ELSE p.last END, q.i - p.last > 63 FROM e2 p JOIN e1 q ON q.symbol = p.symbol AND q.level = p.level AND q.k = p.k + 1)",
    "e3 AS MATERIALIZED (SELECT e1.* FROM e1 JOIN e2 USING (symbol, level, k) WHERE keep)",
    "e4 AS (SELECT e3.symbol, e3.level, e3.i, min(z.i) AS ti FROM e3 JOIN e0 z ON z.symbol = e3.symbol AND z.i > e3.i AND z.i <= e3.i + 63 AND z.close <= z.ma GROUP BY 1, 2, 3)",
    "e5 AS (SELECT e3.*, e4.ti, (e3.close - z.close) / (e3.close - e3.ma) AS ps, z.fwd21 AS aft FROM e3 LEFT JOIN e4 ON e4.symbol = e3.symbol AND e4.level = e3.level AND e4.i = e3.i LEFT JOIN e0 z ON z.symbol = e3.symbol AND z.i = e4.ti)",
]


@query(
    "extension_episodes",
    "F48",
    P.with_(PX, *EPI, recursive=True)
    + "SELECT level, count(*) AS episodes, avg(fwd) AS mean_fwd, avg(worst) AS mean_worst, avg((ti IS NOT NULL)::INT) AS touch_rate, avg(ti - i) AS mean_touch_bar, avg(ps) AS price_share, avg(aft) AS after_touch_21 FROM e5 GROUP BY level",
)
def extension_episodes(spark, d):
    return X.extension_episodes(P.brand_px(spark, d), (0.05, 0.10))
