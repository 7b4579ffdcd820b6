"""Composite verdict queries on the brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composites as CO
from ..operators import evaluations as E
from ..operators import ledger as LG
from ..operators import levels as L
from ..operators import regimes as R
from ..operators import trades as TR
from ..sources import feeds as FD
from . import feeds as PFD
from . import panels as P
from .candles import events_cte, geometry_cte, volume_ctes
from .crosssection import PULSE, SEC_SQL, sector_px
from .evaluations import candle_ctes
from .indicators import ALL_CTES, WS, full, numbered
from .levels import LV, PV, RES
from .patterns import CHART, EXT as SWING, LEVELS, PATTERNS
from .registry import query
from .regimes import AGE, ALIGN, BENCH, CROSS_CTES, EXT, GAPS, MTF, REGIME, RS_SQL, RSI_CTES, TEMPLATE, WATCH, at, tail
from .trades import DIP_STATE, plan_ctes

PX = P.px_sql("brand")
AS_OF = "1999-06-01"


def px(spark, d):
    return P.brand_px(spark, d)


def past(spark, d):
    """Bars as they stood on the as-of day, so events lie ahead of them."""
    return px(spark, d).where(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))


def runup(spark, d):
    nxt = FD.next_event_date(PFD.events(spark, d), F.lit(AS_OF).cast("timestamp"))
    return CO.earnings_runup(past(spark, d), nxt, big=0.01, days=30)


RUN = [
    f"pa AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS age FROM px WHERE ts <= TIMESTAMP '{AS_OF}')",
    "pg AS (SELECT symbol, CASE WHEN count(*) > 11 THEN max(close) FILTER (age = 0) / max(close) FILTER (age = 10) - 1 END AS runup FROM pa GROUP BY 1)",
    f"""ne AS (SELECT p_brand AS symbol, CAST(min(CAST(l_shipdate AS DATE)) AS TIMESTAMP) AS next_event, date_diff('day', DATE '{AS_OF}', min(CAST(l_shipdate AS DATE))) AS days_to_event FROM lineitem JOIN part ON l_partkey = p_partkey
 WHERE l_shipdate >= TIMESTAMP '{AS_OF}' AND l_shipdate <= CAST(DATE '{AS_OF}' + 120 AS TIMESTAMP) GROUP BY 1)""",
    "rn AS MATERIALIZED (SELECT symbol, next_event, days_to_event, runup, days_to_event <= 30 AS soon, coalesce(days_to_event <= 30 AND runup >= 0.01, false) AS hot_runup FROM ne JOIN pg USING (symbol))",
]


@query("earnings_runup", "E20", P.with_(PX, *RUN) + "SELECT * FROM rn")
def earnings_runup(spark, d):
    return runup(spark, d)


def consensus(spark, d):
    """Consensus rows derived from the catalogue of each brand."""
    p = P.table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.count(F.lit(1)).alias("n_analysts"), (70.0 + 2 * F.avg("p_size")).alias("target_mean"), F.avg("p_size").alias("m")
    )
    m = F.col("m")
    key = F.when(m > 27, "strong_buy").when(m > 25, "buy").when(m > 24, "hold").otherwise("market_weight")
    return p.select("symbol", "n_analysts", "target_mean", key.alias("rating_key"))


CONS = [
    "ci AS (SELECT p_brand AS symbol, count(*) AS n_analysts, 70 + 2 * avg(p_size) AS target_mean, avg(p_size) AS m FROM part GROUP BY 1)",
    f"cp AS (SELECT symbol, {at(0)} AS price, CASE WHEN count(*) > 63 THEN {at(0)} / max(close) FILTER (age < 63) - 1 END AS dd FROM ag GROUP BY 1)",
    """cs AS MATERIALIZED (SELECT symbol, price, target_mean, n_analysts, CASE WHEN m > 27 THEN 'Strong Buy' WHEN m > 25 THEN 'Buy' WHEN m > 24 THEN 'Hold' ELSE 'Market_weight' END AS rating, target_mean / price - 1 AS upside,
 coalesce(dd < -0.12 AND target_mean / price - 1 > 0.1 AND m > 25, false) AS calm FROM ci JOIN cp USING (symbol))""",
]


@query("consensus_snapshot", "E21", P.with_(PX, AGE, *CONS) + "SELECT * FROM cs")
def consensus_snapshot(spark, d):
    return CO.consensus_snapshot(px(spark, d), consensus(spark, d))


def bench(spark, d):
    return P.shared(spark, d, "market", lambda: P.market(P.type_px(spark, d)))


def insider(spark, d):
    return P.shared(spark, d, "insider", lambda: PFD.insider_summary(spark, d))


def strength(spark, d):
    return P.shared(spark, d, "strength", lambda: R.relative_strength(px(spark, d), bench(spark, d)))


def template(spark, d):
    return P.shared(spark, d, "template", lambda: R.trend_template(px(spark, d), strength(spark, d)))


def conviction_frame(spark, d):
    cross = P.shared(spark, d, "crossover", lambda: R.crossover_system(px(spark, d)))
    return CO.conviction(strength(spark, d), template(spark, d), insider(spark, d), runup(spark, d), cross)


CONV = [
    *CROSS_CTES,
    AGE,
    BENCH,
    RS_SQL,
    TEMPLATE,
    *RUN,
    PFD.TX,
    "mx AS (SELECT max(ts) AS t FROM tx)",
    "iv AS (SELECT issuer AS symbol, count(DISTINCT owner) FILTER (code = 'P') AS np, coalesce(sum(shares) FILTER (code = 'P'), 0) AS bs, coalesce(sum(shares * price) FILTER (code = 'P'), 0) AS bv, coalesce(sum(shares) FILTER (code = 'S'), 0) AS ss, coalesce(sum(shares * price) FILTER (code = 'S'), 0) AS sv FROM tx, mx WHERE ts >= t - INTERVAL 90 DAY GROUP BY 1)",
    "iw AS (SELECT symbol, np >= 3 AND bs > 0 AS cluster, CASE WHEN bv > 0 THEN bv ELSE bs END AS b, CASE WHEN sv > 0 THEN sv ELSE ss END AS s FROM iv)",
    "ix AS (SELECT symbol, cluster, CASE WHEN b > 0 AND b >= s THEN 'buying' WHEN s > 0 AND s > b THEN 'selling' ELSE 'routine' END AS sig FROM iw)",
    """cv0 AS (SELECT symbol, CASE WHEN rstr.outperforming THEN 2 ELSE 0 END AS mb, CASE WHEN NOT rstr.outperforming THEN 2 ELSE 0 END AS mr, CASE WHEN available AND passes THEN 1 ELSE 0 END AS tb,
 CASE WHEN available AND NOT passes AND stage <> 2 THEN 1 ELSE 0 END AS tr, CASE WHEN coalesce(cluster, false) OR coalesce(sig = 'buying', false) THEN 2 ELSE 0 END AS ib,
 CASE WHEN NOT (coalesce(cluster, false) OR coalesce(sig = 'buying', false)) AND coalesce(sig = 'selling', false) THEN 1 ELSE 0 END AS inn, CASE WHEN hot_runup THEN 1 ELSE 0 END AS ca, CASE WHEN cro.state IN ('buy', 'sell') THEN 1 ELSE 0 END AS xc, cro.state AS xs
 FROM tmpl FULL JOIN rstr USING (symbol) FULL JOIN ix USING (symbol) FULL JOIN rn USING (symbol) FULL JOIN cro USING (symbol))""",
    """cv AS MATERIALIZED (SELECT symbol, mb + mr + tb + tr + ib + inn + ca + xc > 0 AS available, CAST((mb > 0)::INT + (tb > 0)::INT + (ib > 0)::INT AS BIGINT) AS aligned, CAST(mb + tb + ib - mr - tr - ca AS BIGINT) AS net, (mb > 0)::INT + (ib > 0)::INT AS sb, mb + tb + ib AS bull, mr + tr AS bear,
 CAST((mb > 0)::INT + (mr > 0)::INT + (tb > 0)::INT + (tr > 0)::INT + (ib > 0)::INT + inn + ca + xc AS BIGINT) AS n_components, ca > 0 AS caution,
 concat_ws(',', CASE WHEN mb > 0 THEN 'momentum:strong:bullish:2' END, CASE WHEN mr > 0 THEN 'momentum:strong:bearish:2' END, CASE WHEN tb > 0 THEN 'trend_stage:moderate:bullish:1' END, CASE WHEN tr > 0 THEN 'trend_stage:moderate:bearish:1' END,
 CASE WHEN ib > 0 THEN 'insider_buying:strong:bullish:2' END, CASE WHEN inn > 0 THEN 'insider_activity:weak:neutral:0' END, CASE WHEN ca > 0 THEN 'earnings_runup:moderate:caution:1' END,
 CASE WHEN xs = 'buy' THEN 'crossover:weak:bullish:0' WHEN xs = 'sell' THEN 'crossover:weak:bearish:0' END) AS components FROM cv0)""",
]


@query(
    "conviction_stack",
    "E23",
    P.with_(*CONV, recursive=True)
    + """SELECT symbol, available, CASE WHEN aligned >= 2 AND sb >= 1 AND bear = 0 THEN 'high_bull' WHEN net <= -2 THEN 'bear' WHEN bull = 0 AND bear = 0 THEN 'none' ELSE 'mixed' END AS verdict,
 CASE WHEN aligned >= 2 AND sb >= 1 AND bear = 0 THEN 'up' WHEN net <= -2 THEN 'down' END AS direction, aligned, net, n_components, caution, components FROM cv""",
)
def conviction_stack(spark, d):
    c = conviction_frame(spark, d)
    listed = F.transform("components", lambda x: F.concat_ws(":", x["name"], x["strength"], x["state"], x["weight"].cast("string")))
    return c.withColumn("components", F.array_join(listed, ","))


# every latest read the composites need; ALL_CTES brings the bars as ``b``
FACTS_BASE = [
    numbered(PX, "px"),
    *ALL_CTES[1:],
    AGE,
    *MTF[1:],
    ALIGN,
    REGIME,
    BENCH,
    RS_SQL,
    TEMPLATE,
    geometry_cte(),
    events_cte(),
    *volume_ctes(),
    CHART,
    SWING,
    *LEVELS,
    "li AS MATERIALIZED (SELECT symbol, " + ", ".join(f"arg_max({c}, ts) FILTER ({c} IS NOT NULL) AS {c}" for c in ("close", "sma50", "rsi", "macd", "macd_signal")) + " FROM ind GROUP BY 1)",
    "cd AS MATERIALIZED (SELECT symbol, name, bias, pos FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, rank) AS pos FROM cev WHERE n - i <= 40) WHERE pos <= 12)",
    """fa AS MATERIALIZED (SELECT li.*, above_sma200, reg."cross" AS crs, alignment, stage, passes, cd.bias AS candle_bias, coalesce(vb_, 0) AS v_break, coalesce(vd_, 0) AS v_down, coalesce(vr_, 0) AS v_dry, nr, ns FROM li
 LEFT JOIN reg USING (symbol) LEFT JOIN al USING (symbol) LEFT JOIN tmpl USING (symbol) LEFT JOIN (SELECT * FROM cd WHERE pos = 1) cd USING (symbol)
 LEFT JOIN (SELECT symbol, max((name = 'Breakout on Volume')::INT) AS vb_, max((name = 'Breakdown on Volume')::INT) AS vd_, max((name = 'Volume Dry-Up')::INT) AS vr_ FROM vrec GROUP BY 1) USING (symbol)
 LEFT JOIN (SELECT symbol, max(level) FILTER (kind = 'resistance') AS nr, max(level) FILTER (kind = 'support') AS ns FROM sr WHERE pos = 1 GROUP BY 1) USING (symbol))""",
    """fb AS (SELECT *, coalesce(above_sma200, false)::INT + coalesce(crs = 'golden', false)::INT + (alignment IN ('strong_up', 'mostly_up'))::INT + coalesce(macd > macd_signal, false)::INT + 2 * coalesce(stage = 2, false)::INT + coalesce(candle_bias = 'bullish', false)::INT AS bull,
 coalesce(NOT above_sma200, false)::INT + coalesce(crs = 'death', false)::INT + (alignment IN ('strong_down', 'mostly_down'))::INT + coalesce(NOT macd > macd_signal, false)::INT + 2 * coalesce(stage = 4, false)::INT + coalesce(candle_bias = 'bearish', false)::INT AS bear FROM fa)""",
    "fc AS MATERIALIZED (SELECT *, CASE WHEN bull > bear THEN 'bullish' WHEN bear > bull THEN 'bearish' ELSE 'neutral' END AS bs, coalesce(nr / close - 1 <= 0.03, false) AS atr_, coalesce(ns / close - 1 >= -0.03, false) AS ats_ FROM fb)",
]


@query(
    "directional_bias",
    "E25",
    P.with_(*FACTS_BASE, recursive=True)
    + "SELECT symbol, CAST(bull AS BIGINT) AS bull, CAST(bear AS BIGINT) AS bear, bs AS bias, nr AS near_resistance, ns AS near_support, atr_ AS at_resistance, ats_ AS at_support FROM fc",
)
def directional_bias(spark, d):
    return CO.directional_bias(facts(spark, d)).select(
        "symbol", "bull", "bear", "bias", "near_resistance", "near_support", "at_resistance", "at_support"
    )


_RULES = [
    ("stage2_uptrend", "'bullish'", 1, "passes"),
    ("continuation_at_support", "'bullish'", 1, "bs = 'bullish' AND NOT coalesce(rsi > 70, false) AND ats_ AND candle_bias = 'bullish'"),
    ("coil_below_resistance", "'bullish'", 1, "bs = 'bullish' AND atr_ AND v_dry = 1"),
    ("breakout_confirmed", "'bullish'", 1, "v_break = 1"),
    ("extended", "'neutral'", 2, "bs = 'bullish' AND rsi > 70"),
    ("caution_at_resistance", "'bearish'", 2, "bs = 'bullish' AND atr_ AND candle_bias = 'bearish'"),
    ("downtrend_regime", "'bearish'", 1, "bs = 'bearish' AND (crs = 'death' OR NOT above_sma200)"),
    ("oversold_bounce", "'neutral'", 2, "bs = 'bearish' AND rsi < 30 AND candle_bias = 'bullish'"),
    ("breakdown_confirmed", "'bearish'", 1, "v_down = 1"),
    ("choppy_range", "'neutral'", 2, "alignment = 'mixed'"),
    ("macd_momentum", "CASE WHEN macd > macd_signal THEN 'bullish' ELSE 'bearish' END", 3, "macd_signal IS NOT NULL"),
]


@query(
    "situation_rules",
    "E26",
    P.with_(
        *FACTS_BASE,
        "ru AS (" + " UNION ALL ".join(f"SELECT symbol, bs AS bias, '{c}' AS rule, {b} AS rule_bias, {p}::BIGINT AS priority, {i} AS o FROM fc WHERE {k}" for i, (c, b, p, k) in enumerate(_RULES)) + ")",
        recursive=True,
    )
    + "SELECT symbol, bias, pos, rule, rule_bias, priority FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority, o) AS pos FROM ru) WHERE pos <= 6",
)
def situation_rules(spark, d):
    return CO.situation_rules(facts(spark, d))


def posture(spark, d):
    return P.shared(spark, d, "posture_inputs", lambda: CO.posture_inputs(px(spark, d), bench(spark, d)))


def facts(spark, d):
    return P.shared(spark, d, "facts", lambda: CO.situation_inputs(px(spark, d), bench(spark, d)))


def posture_frame(spark, d):
    return CO.posture_score(posture(spark, d))


POSTURE_SQL = [
    *FACTS_BASE,
    *PATTERNS,
    "pt AS (SELECT symbol, CASE WHEN s > 0.05 THEN 1.0 WHEN s < -0.05 THEN -1.0 ELSE 0.0 END * (0.5 + 0.5 * r2) AS trend FROM (SELECT symbol, 100 * regr_slope(close, x) / avg(close) AS s, regr_r2(close, x) AS r2 FROM ch GROUP BY 1))",
    "vv AS (SELECT symbol, sum(CASE WHEN name = 'Breakout on Volume' THEN 0.6 WHEN name = 'Breakdown on Volume' THEN -0.6 WHEN name = 'Volume Spike' AND bias = 'bullish' THEN 0.2 WHEN name = 'Volume Spike' THEN -0.2 ELSE 0 END) AS v FROM vrec WHERE pos <= 3 GROUP BY 1)",
    *candle_ctes("brand")[3:],
    "ce AS (SELECT cd.symbol, sum(CASE cd.bias WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END * (0.4 + 2 * greatest(0, coalesce(edge, 0))) * (1 - 0.3 * (pos - 1))) / sum(1 - 0.3 * (pos - 1)) AS c FROM cd LEFT JOIN cb ON cb.symbol = cd.symbol AND cb.name = cd.name AND cb.bias = cd.bias AND cb.horizon = 10 WHERE pos <= 3 GROUP BY 1)",
    "pc AS (SELECT symbol, sum(CASE bias WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END) / 3.0 AS p FROM pat WHERE pos <= 3 GROUP BY 1)",
    """po AS MATERIALIZED (SELECT symbol, CAST(trend AS DOUBLE) AS trend, (al.ups - al.downs) / al.horizons AS multi_timeframe, CASE WHEN reg."cross" IS NOT NULL THEN CAST(CASE WHEN reg.above_sma200 THEN 0.5 ELSE -0.5 END + CASE WHEN reg."cross" = 'golden' THEN 0.5 ELSE -0.5 END AS DOUBLE) END AS regime,
 CAST(CASE WHEN rsi >= 70 THEN -0.6 WHEN rsi <= 30 THEN 0.6 ELSE (rsi - 50) / 40 * 0.4 END AS DOUBLE) AS rsi, CAST(CASE WHEN macd > macd_signal THEN 0.6 ELSE -0.6 END AS DOUBLE) AS macd,
 CASE WHEN tmpl.available THEN CASE WHEN tmpl.stage = 4 THEN least((score - 4) / 4.0::DOUBLE, -0.5) WHEN tmpl.stage = 2 THEN greatest((score - 4) / 4.0::DOUBLE, 0.5) ELSE (score - 4) / 4.0::DOUBLE END END AS template,
 CAST(c AS DOUBLE) AS candles, CAST(coalesce(v, 0) AS DOUBLE) AS volume, CAST(p AS DOUBLE) AS patterns, rstr.value AS relative_strength FROM li JOIN pt USING (symbol) LEFT JOIN al USING (symbol) LEFT JOIN reg USING (symbol)
 LEFT JOIN tmpl USING (symbol) LEFT JOIN ce USING (symbol) LEFT JOIN vv USING (symbol) LEFT JOIN pc USING (symbol) LEFT JOIN rstr USING (symbol))""",
]
_WEIGHED = " UNION ALL ".join(f"SELECT symbol, least(1.0, greatest(-1.0, {n})) AS v, {wt}::DOUBLE AS w FROM po WHERE {n} IS NOT NULL" for n, wt in CO.POSTURE_WEIGHTS.items())
SCORE_POSTURE = [
    f"pv AS ({_WEIGHED})",
    "pm AS (SELECT symbol, sum(v * w) / sum(w) AS m FROM pv GROUP BY 1)",
    "ps AS (SELECT symbol, any_value(m) AS m, sqrt(sum(w * (v - m) * (v - m)) / sum(w)) AS s, count(*) AS n_components FROM pv JOIN pm USING (symbol) GROUP BY 1)",
    """pf AS MATERIALIZED (SELECT symbol, 100 * m AS score, greatest(-100.0, 100 * m - least(100 * s, 100.0)) AS low, least(100.0, 100 * m + least(100 * s, 100.0)) AS high,
 greatest(0.0, least(100.0, (1 - s) * 100)) AS confidence, CASE WHEN 100 * m >= 50 THEN 'strongly_bullish' WHEN 100 * m >= 20 THEN 'bullish' WHEN 100 * m <= -50 THEN 'strongly_bearish'
 WHEN 100 * m <= -20 THEN 'bearish' ELSE 'neutral' END AS posture, CASE WHEN 100 * m >= 20 THEN 'BUY' WHEN 100 * m <= -20 THEN 'SELL' ELSE 'HOLD' END AS verdict, n_components FROM ps)""",
]


@query("posture_score", "E24", P.with_(*POSTURE_SQL, *SCORE_POSTURE, recursive=True) + "SELECT * FROM pf")
def posture_score(spark, d):
    return posture_frame(spark, d)


@query("posture_components", "E24", P.with_(*POSTURE_SQL, recursive=True) + "SELECT * FROM po")
def posture_components(spark, d):
    return posture(spark, d)


LATEST_PULSE = "lp AS (SELECT symbol, arg_max(event, ts) AS event, arg_max(coalesce(event, '-'), ts) AS ev FROM pu GROUP BY 1)"


def latest_pulse(spark, d):
    from ..operators import crosssection as X

    p = X.sector_pulse(sector_px(spark, d), broad=0.6)
    g = p.groupBy("symbol").agg(F.max_by(F.coalesce("event", F.lit("-")), "ts").alias("event"))
    return g.select("symbol", F.when(F.col("event") != "-", F.col("event")).alias("event"))


CHECKLIST = """SELECT symbol, 'long_term_trend' AS factor, CASE WHEN uptrend THEN 'good' ELSE 'bad' END AS status FROM res WHERE uptrend IS NOT NULL
 UNION ALL SELECT res.symbol, 'dip_signal', CASE WHEN dip_active THEN 'good' ELSE 'info' END FROM res JOIN dst USING (symbol)
 UNION ALL SELECT res.symbol, 'sector_context', CASE WHEN ev = 'broad_selloff' THEN 'warn' ELSE 'info' END FROM res JOIN lp USING (symbol) WHERE ev <> '-'
 UNION ALL SELECT res.symbol, 'stretch', CASE WHEN exs.state IN ('extended', 'blowoff', 'stretched_below') THEN 'warn' ELSE 'good' END FROM res JOIN exs USING (symbol) WHERE exs.state <> 'normal'
 UNION ALL SELECT res.symbol, 'earnings_risk', CASE WHEN hot_runup THEN 'bad' ELSE 'warn' END FROM res JOIN rn USING (symbol) WHERE soon
 UNION ALL SELECT res.symbol, 'street_consensus', 'info' FROM res JOIN cs USING (symbol)
 UNION ALL SELECT res.symbol, 'opening_gap', 'info' FROM res JOIN gd USING (symbol) WHERE gd.age = 0 AND gd.n >= 121 AND gd.direction IS NOT NULL AND gd.symbol IN (SELECT symbol FROM gs)"""
CHECKED = P.with_(numbered(PX, "px"), *DIP_STATE, AGE, PV, LV, RES, EXT, GAPS, *CONS, *RUN, SEC_SQL, PULSE, LATEST_PULSE, recursive=True)


@query("buy_checklist", "E27", CHECKED + CHECKLIST)
def buy_checklist(spark, d):
    b = px(spark, d)
    return CO.buy_checklist(
        L.resistance_state(b), TR.dip_state(b), latest_pulse(spark, d), R.extension_state(b), runup(spark, d), CO.consensus_snapshot(b, consensus(spark, d)), R.gap_today(b)
    )


@query("checklist_factors", "E27", CHECKED + CHECKLIST)
def checklist_factors(spark, d):
    return buy_checklist(spark, d)


def read_ctes() -> list[str]:
    """pattern_read in SQL: full history and last-504-bar statistics."""
    base = candle_ctes("brand")

    def renamed(sfx: str, src: str) -> list[str]:
        out = []
        for c in base[1:]:
            for n in ("geo", "cev", "fw", "bu", "ccl", "cb"):
                import re

                c = re.sub(rf"\b{n}\b", n + sfx, c)
            c = re.sub(r"\bpx\b", src, c)
            out.append(c)
        return out

    ev = "rx AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, name, bias, rank, n - 1 - i AS ago, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, rank) AS pos FROM cev_f WHERE n - i <= 15) WHERE pos <= 12 AND ago <= 10)"

    def rows(sfx: str) -> str:
        return f"""rr{sfx} AS MATERIALIZED (SELECT rx.*, c.samples, c.win_rate, c.edge, c.base_up, CASE WHEN rx.bias = 'bearish' THEN 1 - c.win_rate ELSE c.win_rate END AS p, sqrt(least(c.samples, 40)) * 0.9 ** ago AS w
 FROM rx JOIN cb{sfx} c ON c.symbol = rx.symbol AND c.name = rx.name AND c.bias = rx.bias AND c.horizon = 10 WHERE c.samples >= 10)"""

    def tilt(sfx: str) -> str:
        return f"""rt{sfx} AS (SELECT symbol, count(*) AS ns, sum(p * w) / sum(w) AS p_up, max(base_up) AS bup, sum(CASE WHEN p >= base_up THEN w ELSE 0 END) / sum(w) AS bw FROM rr{sfx} GROUP BY 1)"""

    return [
        PX,
        "pz AS MATERIALIZED (SELECT * FROM px WHERE n - i <= 504)",
        *renamed("_f", "px"),
        *renamed("_r", "pz"),
        ev,
        rows("_f"),
        rows("_r"),
        tilt("_f"),
        tilt("_r"),
        "fl AS (SELECT symbol, count(*) AS c FROM (SELECT DISTINCT symbol, name, edge FROM rr_f) a JOIN (SELECT DISTINCT symbol, name, edge AS er FROM rr_r) b USING (symbol, name) WHERE sign(edge) <> sign(er) OR abs(edge - er) > 0.15 GROUP BY 1)",
        "nn AS (SELECT symbol, count(*) AS n FROM px GROUP BY 1 HAVING count(*) >= 150)",
    ]


@query(
    "pattern_read",
    "E28",
    P.with_(*read_ctes())
    + """SELECT nn.symbol, coalesce(f.ns, 0) AS n_signals, f.p_up, f.bup AS baseline_up, coalesce(100 * (f.p_up - f.bup), 0) AS tilt_pp, CASE WHEN 100 * (f.p_up - f.bup) > 2 THEN 'BULLISH' WHEN 100 * (f.p_up - f.bup) < -2 THEN 'BEARISH' WHEN f.p_up IS NOT NULL THEN 'FLAT' END AS direction,
 coalesce(f.bw BETWEEN 0.35 AND 0.65, false) AS conflict, CASE WHEN n > 564 THEN r.p_up END AS p_up_recent, CASE WHEN n > 564 THEN 100 * (r.p_up - r.bup) END AS tilt_recent_pp, CASE WHEN n > 564 AND f.ns IS NOT NULL THEN coalesce(fl.c, 0) END AS unstable_patterns
 FROM nn LEFT JOIN rt_f f ON f.symbol = nn.symbol LEFT JOIN rt_r r ON r.symbol = nn.symbol LEFT JOIN fl ON fl.symbol = nn.symbol""",
)
def pattern_read(spark, d):
    return CO.pattern_read(px(spark, d))


@query(
    "pattern_contributors",
    "E28",
    P.with_(*read_ctes())
    + "SELECT symbol, pos, name, bias, bars_ago, samples, win_rate, edge, p_up, w FROM (SELECT symbol, name, bias, ago AS bars_ago, samples, win_rate, edge, p AS p_up, w, row_number() OVER (PARTITION BY symbol ORDER BY abs(p - base_up) * w DESC, ago, rank) AS pos FROM rr_f) WHERE pos <= 3",
)
def pattern_contributors(spark, d):
    return CO.pattern_contributors(px(spark, d))


# fixed values: alert rule types with their default thresholds
ALERTS = [
    ("rsi_below", 45.0), ("rsi_above", 55.0), ("price_below", 96.0), ("price_above", 90.0), ("confidence_above", 40.0),
    ("verdict_buy", 0.0), ("verdict_sell", 0.0), ("stage2", 0.0), ("golden", 0.0), ("death", 0.0),
]


def snapshot(spark, d):
    return P.shared(spark, d, "snapshot", lambda: _snapshot(spark, d))


def _snapshot(spark, d):
    b = px(spark, d)
    return (
        CO.latest_indicators(b)
        .join(R.ma_regime(b).select("symbol", "cross", "above_sma200"), "symbol", "left")
        .join(template(spark, d).select("symbol", "passes", "stage", "score"), "symbol", "left")
    )


@query(
    "alert_rules",
    "E30",
    P.with_(*FACTS_BASE, "al_(type, value) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in ALERTS if t not in ("confidence_above", "verdict_buy", "verdict_sell")) + ")", recursive=True)
    + """SELECT type || ':' || symbol AS rule_id, symbol, type, value, coalesce(CASE type WHEN 'rsi_below' THEN rsi < value WHEN 'rsi_above' THEN rsi > value WHEN 'price_below' THEN close < value WHEN 'price_above' THEN close > value
 WHEN 'stage2' THEN passes OR stage = 2 WHEN 'golden' THEN crs = 'golden' WHEN 'death' THEN crs = 'death' END, false) AS fired FROM fa, al_""",
)
def alert_rules(spark, d):
    s = snapshot(spark, d).withColumns({"confidence": F.lit(None).cast("double"), "verdict": F.lit(None).cast("string")})
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in ALERTS if t not in ("confidence_above", "verdict_buy", "verdict_sell")]))
    rules = s.select("symbol", kinds.alias("r")).select(F.concat_ws(":", "r.type", "symbol").alias("rule_id"), "symbol", "r.type", "r.value")
    return CO.alert_rules(rules, s)


@query(
    "alert_rules_posture",
    "E30",
    P.with_(*POSTURE_SQL, *SCORE_POSTURE, "al_(type, value) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in ALERTS) + ")", recursive=True)
    + """SELECT type || ':' || symbol AS rule_id, symbol, type, value, coalesce(CASE type WHEN 'rsi_below' THEN rsi < value WHEN 'rsi_above' THEN rsi > value WHEN 'price_below' THEN close < value WHEN 'price_above' THEN close > value
 WHEN 'confidence_above' THEN confidence > value WHEN 'verdict_buy' THEN verdict = 'BUY' WHEN 'verdict_sell' THEN verdict = 'SELL'
 WHEN 'stage2' THEN passes OR stage = 2 WHEN 'golden' THEN crs = 'golden' WHEN 'death' THEN crs = 'death' END, false) AS fired FROM fa LEFT JOIN pf USING (symbol), al_""",
)
def alert_rules_posture(spark, d):
    p = posture_frame(spark, d).select("symbol", "confidence", "verdict")
    s = snapshot(spark, d).join(p, "symbol", "left")
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in ALERTS]))
    rules = s.select("symbol", kinds.alias("r")).select(F.concat_ws(":", "r.type", "symbol").alias("rule_id"), "symbol", "r.type", "r.value")
    return CO.alert_rules(rules, s)


@query(
    "compare_symbols",
    "E31",
    P.with_(
        *FACTS_BASE,
        "sn AS (SELECT symbol, CAST(tmpl.score AS VARCHAR) AS score, crs AS \"cross\", CAST(tmpl.stage AS VARCHAR) AS stage FROM fa JOIN tmpl USING (symbol))",
        "un AS (UNPIVOT sn ON score, \"cross\", stage INTO NAME metric VALUE v)",
        recursive=True,
    )
    + "SELECT a.symbol AS a, b.symbol AS b, a.metric, a.v AS value_a, b.v AS value_b FROM un a JOIN un b ON b.metric = a.metric AND b.symbol = 'Brand#' || (CAST(substr(a.symbol, 7) AS INTEGER) + 1) WHERE CAST(substr(a.symbol, 7) AS INTEGER) % 2 = 1",
)
def compare_symbols(spark, d):
    from .crosssection import twin_pairs

    return CO.compare_symbols(snapshot(spark, d), twin_pairs(spark, d), ["score", "cross", "stage"])


@query(
    "recent_move",
    "E32",
    P.with_(
        PX,
        AGE,
        geometry_cte(),
        events_cte(),
        f"m AS (SELECT symbol, {at(0)} / {at(5)} - 1 AS c, max(close) FILTER (age = 0) >= max(open) FILTER (age = 0) AS up_day FROM ag GROUP BY 1)",
        "k AS (SELECT symbol, name, bias FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, rank) AS p FROM cev WHERE n - i <= 3) WHERE p = 1)",
    )
    + "SELECT symbol, c AS change5, CASE WHEN 100 * c > 4 THEN 'strong_push' WHEN 100 * c > 1 THEN 'drifting_up' WHEN 100 * c < -4 THEN 'sharp_drop' WHEN 100 * c < -1 THEN 'drifting_down' ELSE 'flat' END AS move, up_day, name AS candle, bias AS candle_bias FROM m LEFT JOIN k USING (symbol)",
)
def recent_move(spark, d):
    return CO.recent_move(px(spark, d))


def once(*ctes: str) -> list[str]:
    """The expressions without those whose name came before."""
    seen: dict[str, str] = {}
    for c in ctes:
        seen.setdefault(c.split(" AS ", 1)[0].split("(")[0].strip(), c)
    return list(seen.values())


SCAN = [
    *once(*RSI_CTES, WATCH, AGE, BENCH, RS_SQL, geometry_cte(), events_cte(), *DIP_STATE, *plan_ctes(21, PX)),
    "dto2 AS (SELECT symbol, count(*) AS n_trades, avg(ret) AS avg_per_trade, coalesce(quantile_cont(ret, 0.5) FILTER (ret > 0), 0.02) AS bounce FROM dt GROUP BY symbol)",
    "dnow AS (SELECT symbol, rsi2 FROM dp WHERE i = n - 1)",
    "rvs AS (SELECT symbol, max((bias = 'bullish')::INT) = 1 AS reversal FROM cev WHERE n - i <= 4 GROUP BY 1)",
    f"sg0 AS (SELECT symbol, count(close) AS nn, {at(0)} AS price, {at(0, 'rsi')} AS rsi, {tail('avg', 20)} AS s20, {tail('avg', 200)} AS s200 FROM ri GROUP BY symbol)",
    "sg1 AS (SELECT sg0.*, coalesce(excess, -0.99) AS ex, coalesce(reversal, false) AS reversal FROM sg0 LEFT JOIN rstr USING (symbol) LEFT JOIN rvs USING (symbol) WHERE nn >= 210)",
    """scn AS MATERIALIZED (SELECT symbol, price, CASE WHEN price > s200 AND ex > 0 AND sg1.rsi IS NOT NULL THEN
 least(100 * (0.55 * least(1, greatest(0, (55 - sg1.rsi) / 30)) + 0.35 * least(1, greatest(0, (s20 / price - 1) / 0.05)) + 0.1) + CASE WHEN reversal THEN 8.0 ELSE 0.0 END, 100.0) ELSE 0.0 END AS setup_score,
 price > s200 AS in_uptrend, ex > 0 AS outperforming, sg1.rsi, reversal, price * (1 - 0.5 * coalesce(weekly_vol, 0)) AS buy_zone_low, target, stop, p_profit_intraperiod,
 CASE WHEN dip_active THEN 'active' WHEN dip_up THEN 'waiting' WHEN dst.symbol IS NOT NULL THEN 'downtrend' END AS dip_bucket, dst.win_rate AS dip_win_rate, status AS watch, fresh AS watch_fresh,
 CASE WHEN ex > -0.99 THEN ex END AS rs_excess, CASE WHEN dst.symbol IS NOT NULL THEN rsi2 END AS dip_rsi2, CASE WHEN dst.symbol IS NOT NULL THEN n_trades END AS dip_n_trades, CASE WHEN dst.symbol IS NOT NULL THEN avg_per_trade END AS dip_avg,
 CASE WHEN dst.symbol IS NOT NULL THEN bounce END AS dip_bounce, CASE WHEN dip_active THEN price * (1 + bounce) END AS dip_target, CASE WHEN dip_active THEN price * 0.92 END AS dip_stop,
 bwt.level AS watch_level, bwt.dist AS watch_dist, overbought AS watch_overbought, overhead_200 AS watch_overhead_200, dist_200 AS watch_dist_200
 FROM sg1 LEFT JOIN dst USING (symbol) LEFT JOIN dto2 USING (symbol) LEFT JOIN dnow USING (symbol) LEFT JOIN bwt USING (symbol) LEFT JOIN plan USING (symbol))""",
]
_SCANNED = "symbol, price, setup_score, in_uptrend, outperforming, rsi, reversal, buy_zone_low, target, stop, p_profit_intraperiod, dip_bucket, dip_win_rate, watch, watch_fresh"


@query("scan", "E16 K8", P.with_(*SCAN, recursive=True) + f"SELECT {_SCANNED} FROM scn")
def scan(spark, d):
    return CO.scan(px(spark, d), bench(spark, d))


@query("top_setups", "E16 K9", P.with_(*SCAN, recursive=True) + f"SELECT {_SCANNED} FROM scn WHERE setup_score > 0 ORDER BY setup_score DESC, symbol LIMIT 5")
def top_setups(spark, d):
    return CO.top_setups(CO.scan(px(spark, d), bench(spark, d)))


def scan_full(spark, d):
    return P.shared(spark, d, "scan_payload", lambda: CO.scan(px(spark, d), bench(spark, d), payload=True))


@query("scan_payload", "E16", P.with_(*SCAN, recursive=True) + "SELECT * FROM scn")
def scan_payload(spark, d):
    return scan_full(spark, d)


_LISTS = [
    ("dip_active", "dip_bucket = 'active'", "-coalesce(dip_win_rate, 0)", "0"),
    ("dip_waiting", "dip_bucket = 'waiting'", "coalesce(dip_rsi2, 99)", "0"),
    ("dip_downtrend", "dip_bucket = 'downtrend'", "0", "0"),
    ("watch_broke", "watch = 'broke'", "(NOT watch_fresh)::INT", "-watch_dist"),
    ("watch_coiling", "watch = 'coiling'", "-watch_dist", "0"),
    ("top", "setup_score > 0", "-setup_score", "0"),
]


@query(
    "scan_lists",
    "E16 K8 K9",
    P.with_(*SCAN, recursive=True)
    + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS list, row_number() OVER (ORDER BY {a}, {b}, symbol) AS pos, symbol FROM scn WHERE {c}" for n, c, a, b in _LISTS) + ") WHERE list <> 'top' OR pos <= 5",
)
def scan_lists(spark, d):
    return CO.scan_lists(scan_full(spark, d))


def verdict_frame(spark, d):
    """The newest verdicts of the brand panel, one row per symbol."""
    b = px(spark, d)
    return LG.verdict_frame(b, L.resistance_state(b), TR.dip_state(b), CO.pattern_read(b), runup(spark, d), R.crossover_system(b), conviction_frame(spark, d))


_CALLS = [
    ("resistance_breakout", "'up'", "p_reach_ath_63d", "state", "state = 'fresh_breakout'"),
    ("dip_buy", "'up'", "NULL", "NULL", "dip_active"),
    ("pattern_tilt", "CASE WHEN tilt > 2 THEN 'up' ELSE 'down' END", "p_up", "round(tilt, 1)::VARCHAR || 'pp'", "abs(tilt) > 2"),
    ("earnings_runup", "'down'", "NULL", "NULL", "hot_runup"),
    ("ema_macd_crossover", "CASE cro.state WHEN 'buy' THEN 'up' ELSE 'down' END", "NULL", "NULL", "cro.state IN ('buy', 'sell')"),
    ("conviction_stack", "CASE WHEN aligned >= 2 AND sb >= 1 AND bear = 0 THEN 'up' ELSE 'down' END", "NULL", "NULL", "(aligned >= 2 AND sb >= 1 AND bear = 0) OR net <= -2"),
]


@query(
    "extract_signals_latest",
    "I1",
    P.with_(
        *once(*CONV, *DIP_STATE, PV, LV, RES, *read_ctes()),
        "vf AS (SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS price FROM px GROUP BY 1)",
        "tilts AS (SELECT nn.symbol, p_up, 100 * (p_up - bup) AS tilt FROM nn LEFT JOIN rt_f USING (symbol))",
        recursive=True,
    )
    + " UNION ALL ".join(
        f"SELECT CAST(date_trunc('day', vf.ts) AS TIMESTAMP) AS ts, upper(vf.symbol) AS symbol, '{n}' AS signal_type, {dr} AS direction, CAST({p} AS DOUBLE) AS predicted_p, vf.price AS entry_price, CAST({note} AS VARCHAR) AS note FROM vf JOIN {src} USING (symbol) WHERE {c}"
        for (n, dr, p, note, c), src in zip(_CALLS, ("res", "dst", "tilts", "rn", "cro", "cv"), strict=True)
    ),
)
def extract_signals_latest(spark, d):
    return LG.extract_signals(verdict_frame(spark, d))
