"""Posture study queries: the composite as it stood on past bars, against what followed.

The SQL recomputes each sampled bar's chart from its own 260 bars; the operators
use validity intervals and running records instead."""

from __future__ import annotations

from ..operators import composites as CO
from ..operators import posture_study as PS
from ..operators import regimes as R
from . import panels as P
from .candles import events_cte, geometry_cte, volume_ctes
from .composites import bench
from .indicators import ALL_CTES, WS, full, numbered
from .patterns import EXT, PATTERNS
from .registry import query


def _slope(n: int) -> str:
    frame = f"OVER ({WS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {frame} >= {n} THEN 100 * regr_slope(close, i) {frame} / avg(close) {frame} END"


_SIGN = "CASE WHEN {0} > 0.05 THEN 1.0 WHEN {0} < -0.05 THEN -1.0 WHEN {0} IS NOT NULL THEN 0.0 END"
_HORIZONS = [b for _, b in R.HORIZONS]


def series_ctes(every: int) -> list[str]:
    """``pos_`` holds the ten components of each sampled bar; ``pf`` the scores."""
    read = [
        numbered(P.px_sql("type"), "px"),
        *ALL_CTES[1:],
        "mkt AS (SELECT ts, avg(close) AS bench FROM px GROUP BY ts)",
        f"""wx AS MATERIALIZED (SELECT symbol, ts, i, n, close, {", ".join(f"{_slope(b + 1)} AS s{b}" for b in _HORIZONS)}, {_slope(260)} AS sl,
 regr_r2(close, i) OVER ({WS} ROWS BETWEEN 259 PRECEDING AND CURRENT ROW) AS r2, {", ".join(f"{full('avg', 'close', k)} AS m{k}" for k in (50, 150, 200))}, {full('avg', 'close', 200, 22)} AS m200p,
 {full('min', 'close', 252)} AS lo52, {full('max', 'close', 252)} AS hi52, close / lag(close, 251) OVER ({WS}) - 1 AS yr,
 close / lag(close, 125) OVER ({WS}) - bench / lag(bench, 125) OVER ({WS}) AS rs, sum(volume) OVER ({WS} ROWS BETWEEN 259 PRECEDING AND CURRENT ROW) AS vol,
 {", ".join(f"lead(close, {h}) OVER ({WS}) / close - 1 AS fwd_{h}" for h in PS.HORIZONS)} FROM px JOIN mkt USING (ts))""",
        f"sm AS MATERIALIZED (SELECT wx.*, rsi, macd, macd_signal FROM wx JOIN ind USING (symbol, ts) WHERE i >= 260 AND (i - 260) % {every} = 0 AND fwd_{max(PS.HORIZONS)} IS NOT NULL)",
        geometry_cte(),
        events_cte(),
        # Candles: newest three, edge of each pattern over what was known by the bar.
        "ct AS MATERIALIZED (SELECT s.symbol, s.i AS t, e.name, e.bias, row_number() OVER (PARTITION BY s.symbol, s.i ORDER BY e.i DESC, e.rank) AS pos FROM sm s JOIN cev e ON e.symbol = s.symbol AND e.i <= s.i AND e.i > s.i - 40 QUALIFY pos <= 3)",
        f"fw AS (SELECT symbol, i, lead(close, 10) OVER ({WS}) / close - 1 AS f FROM px)",
        "ev AS MATERIALIZED (SELECT symbol, i, name, bias, CASE WHEN bias = 'bearish' THEN f < 0 ELSE f > 0 END AS won FROM cev JOIN fw USING (symbol, i))",
        "er AS (SELECT c.symbol, c.t, c.pos, c.bias, count(*) AS occ, avg(won::INT) FILTER (e.i + 10 <= c.t) AS win FROM ct c JOIN ev e ON e.symbol = c.symbol AND e.name = c.name AND e.bias = c.bias AND e.i <= c.t GROUP BY ALL)",
        "bu AS (SELECT s.symbol, s.i AS t, avg((f > 0)::INT) AS up FROM sm s JOIN fw ON fw.symbol = s.symbol AND fw.i + 10 <= s.i GROUP BY ALL)",
        """cv AS (SELECT symbol, t, sum(CASE bias WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END * (0.4 + 2 * greatest(0, CASE WHEN occ >= 5 THEN coalesce(win - CASE WHEN bias = 'bearish' THEN 1 - up ELSE up END, 0) ELSE 0 END)) * (1 - 0.3 * (pos - 1)))
 / sum(1 - 0.3 * (pos - 1)) AS v FROM er JOIN bu USING (symbol, t) GROUP BY ALL)""",
        *volume_ctes(),
        "vt AS (SELECT s.symbol, s.i AS t, v.i, v.rank, v.name, v.bias, row_number() OVER (PARTITION BY s.symbol, s.i, v.name ORDER BY v.i DESC) AS nth FROM sm s JOIN vev v ON v.symbol = s.symbol AND v.i <= s.i AND v.i > s.i - 40)",
        """vv AS (SELECT symbol, t, sum(CASE WHEN name = 'Breakout on Volume' THEN 0.6 WHEN name = 'Breakdown on Volume' THEN -0.6 WHEN name = 'Volume Spike' AND bias = 'bullish' THEN 0.2 WHEN name = 'Volume Spike' THEN -0.2 ELSE 0 END) AS v
 FROM (SELECT * FROM vt WHERE name <> 'Volume Dry-Up' OR nth <= 2 QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY i DESC, rank) <= 3) GROUP BY ALL)""",
        # A chart of its own for every sampled bar, with the pattern rules of the newest bar.
        "ch AS MATERIALIZED (SELECT s.symbol || '@' || s.i AS symbol, p.ts, p.close, p.i - (s.i - 259) AS x, 260 AS nn FROM sm s JOIN px p ON p.symbol = s.symbol AND p.i BETWEEN s.i - 259 AND s.i)",
        EXT,
        *PATTERNS,
        "pv_ AS (SELECT symbol, sum(CASE bias WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END) / 3.0 AS v FROM pat WHERE pos <= 3 GROUP BY 1)",
    ]
    mtf = " + ".join(_SIGN.format(f"s{b}") for b in _HORIZONS)
    crit = ["close > m150 AND close > m200", "m150 > m200", "m200 > m200p", "m50 > m150 AND m50 > m200", "close > m50", "close >= 1.3 * lo52", "close >= 0.75 * hi52", "coalesce(rs, yr) > 0"]
    score = " + ".join(f"coalesce({c}, false)::INT" for c in crit)
    components = [
        f"tc AS (SELECT *, ({score}) AS sc FROM sm)",
        f"""pos_ AS MATERIALIZED (SELECT tc.symbol, tc.ts, tc.i, CAST({_SIGN.format("sl")} * (0.5 + 0.5 * least(1.0, greatest(0.0, r2))) AS DOUBLE) AS trend, CAST(({mtf}) / {len(_HORIZONS)} AS DOUBLE) AS multi_timeframe,
 CAST(CASE WHEN m200 IS NOT NULL THEN CASE WHEN close > m200 THEN 0.5 ELSE -0.5 END + CASE WHEN m50 > m200 THEN 0.5 ELSE -0.5 END END AS DOUBLE) AS regime,
 CAST(CASE WHEN rsi >= 70 THEN -0.6 WHEN rsi <= 30 THEN 0.6 ELSE (rsi - 50) / 40 * 0.4 END AS DOUBLE) AS rsi, CAST(CASE WHEN macd > macd_signal THEN 0.6 ELSE -0.6 END AS DOUBLE) AS macd,
 CAST(CASE WHEN sc >= 7 AND {crit[0]} AND {crit[3]} AND {crit[4]} THEN greatest((sc - 4) / 4, 0.5) WHEN sc <= 2 AND close < m200 THEN least((sc - 4) / 4, -0.5) ELSE (sc - 4) / 4 END AS DOUBLE) AS template,
 CAST(cv.v AS DOUBLE) AS candles, CAST(CASE WHEN vol <> 0 THEN coalesce(vv.v, 0) END AS DOUBLE) AS volume, CAST(pv_.v AS DOUBLE) AS patterns, CAST(least(1.0, greatest(-1.0, rs / 0.2)) AS DOUBLE) AS relative_strength,
 {", ".join(f"fwd_{h}" for h in PS.HORIZONS)} FROM tc LEFT JOIN cv ON cv.symbol = tc.symbol AND cv.t = tc.i LEFT JOIN vv ON vv.symbol = tc.symbol AND vv.t = tc.i LEFT JOIN pv_ ON pv_.symbol = tc.symbol || '@' || tc.i)""",
        "pw AS (" + " UNION ALL ".join(f"SELECT symbol, i, least(1.0, greatest(-1.0, {n})) AS v, {wt}::DOUBLE AS w FROM pos_ WHERE {n} IS NOT NULL" for n, wt in CO.POSTURE_WEIGHTS.items()) + ")",
        "pm AS (SELECT symbol, i, sum(v * w) / sum(w) AS m FROM pw GROUP BY 1, 2)",
        "ps AS (SELECT symbol, i, any_value(m) AS m, sqrt(sum(w * (v - m) * (v - m)) / sum(w)) AS s, count(*) AS n_components FROM pw JOIN pm USING (symbol, i) GROUP BY 1, 2)",
        """pf AS MATERIALIZED (SELECT pos_.*, 100 * m AS score, greatest(-100.0, 100 * m - least(100 * s, 100.0)) AS low, least(100.0, 100 * m + least(100 * s, 100.0)) AS high, greatest(0.0, least(100.0, (1 - s) * 100)) AS confidence,
 CASE WHEN 100 * m >= 50 THEN 'strongly_bullish' WHEN 100 * m >= 20 THEN 'bullish' WHEN 100 * m <= -50 THEN 'strongly_bearish' WHEN 100 * m <= -20 THEN 'bearish' ELSE 'neutral' END AS posture,
 CASE WHEN 100 * m >= 20 THEN 'BUY' WHEN 100 * m <= -20 THEN 'SELL' ELSE 'HOLD' END AS verdict, n_components FROM pos_ JOIN ps USING (symbol, i))""",
    ]
    return read + components


SERIES = P.with_(*series_ctes(3), recursive=True)


def scored(spark, d):
    return P.shared(spark, d, "posture_series", lambda: PS.scored_series(P.type_px(spark, d), bench(spark, d).select("ts", "close")))


def scored_daily(spark, d):
    """Every bar of a full chart, for evaluations that choose their own bars."""
    return P.shared(spark, d, "posture_daily", lambda: PS.scored_series(P.type_px(spark, d), bench(spark, d).select("ts", "close"), every=1, facts=True))


@query("posture_series", "F43", SERIES + "SELECT * FROM pf")
def posture_series(spark, d):
    return scored(spark, d)


_NAMES = [*PS.COMPONENTS, "score"]


@query(
    "posture_correlations",
    "F43",
    SERIES
    + " UNION ALL ".join(f"SELECT '{n}' AS component, " + ", ".join(f"corr(coalesce({n}, 0), fwd_{h}) AS corr_{h}" for h in PS.HORIZONS) + " FROM pf" for n in _NAMES),
)
def posture_correlations(spark, d):
    return PS.component_correlations(scored(spark, d))


_BY = "count(fwd_20) AS n, avg(fwd_20) AS mean_fwd, avg((fwd_20 > 0)::INT) AS win_rate, quantile_cont(fwd_20, 0.5::DOUBLE) AS median_fwd FROM pf"


@query("posture_returns", "F43", SERIES + f'SELECT verdict AS "group", {_BY} GROUP BY 1 UNION ALL SELECT \'ALL\', {_BY}')
def posture_returns(spark, d):
    return PS.returns_by_verdict(scored(spark, d))


@query(
    "posture_walkforward",
    "F44",
    P.with_(*series_ctes(1), recursive=True)
    + "SELECT symbol, horizon, count(fwd) AS n, "
    + ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v.lower()}, avg(fwd) FILTER (verdict = '{v}') AS mean_{v.lower()}" for v in ("BUY", "HOLD", "SELL"))
    + """, avg(fwd) AS mean_all, CASE WHEN count(fwd) > 2 THEN corr(score, fwd) END AS score_corr FROM (SELECT symbol, verdict, score, unnest([5, 20])::BIGINT AS horizon, unnest([fwd_5, fwd_20]) AS fwd FROM (
 SELECT *, greatest(min(i) OVER (PARTITION BY symbol), max(i) OVER (PARTITION BY symbol) + 61 - 120) AS f FROM pf) WHERE i >= f AND (i - f) % 8 = 0) GROUP BY 1, 2""",
)
def posture_walkforward(spark, d):
    return PS.walkforward_verdicts(scored_daily(spark, d))


@query("posture_logistic", "F43")
def posture_logistic(spark, d):
    return PS.walkforward_logistic(scored(spark, d), "1999-01-01")
