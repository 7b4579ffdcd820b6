"""Evaluations of volatility, bands, crossovers, disclosures and candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluations as E
from . import panels as P
from .candles import events_cte, geometry_cte
from .crosssection import sector_px
from .indicators import WS, numbered, recur
from .registry import query
from .volatility import FIX, vol_ctes


def targets(panel: str) -> list[str]:
    return [
        *[FIX(c) for c in vol_ctes(P.px_sql(panel), "px")],
        f"""vx AS MATERIALIZED (SELECT symbol, ts, i, n, vol_close_to_close AS cc, sqrt(ev) AS ewma, vol_yang_zhang AS yz, sigma AS blend,
 sum(r * r) OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS rvar, ln(lead(close, 5) OVER ({WS}) / close) AS move FROM vols)""",
    ]


VL = "vl AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS estimator, {m} AS s, rvar, abs(move) AS mv FROM vx WHERE i >= 50 AND move IS NOT NULL AND {m} > 0" for m in E.NAMES
) + ")"


@query(
    "vol_eval",
    "F39",
    P.with_(
        *targets("type"),
        VL,
        """vr AS (SELECT *, rank() OVER (PARTITION BY estimator ORDER BY s) + (count(*) OVER (PARTITION BY estimator, s) - 1) / 2.0 AS rs,
 rank() OVER (PARTITION BY estimator ORDER BY mv) + (count(*) OVER (PARTITION BY estimator, mv) - 1) / 2.0 AS rm FROM vl)""",
        recursive=True,
    )
    + """SELECT estimator, count(*) AS n, avg(CASE WHEN rvar > 0 THEN rvar / (s * s * 5) - ln(rvar / (s * s * 5)) - 1 END) AS qlike, avg((mv <= 1.96 * s * sqrt(5))::INT) AS coverage,
 avg(2 * 1.96 * s * sqrt(5)) AS width, corr(rs, rm) AS spearman FROM vr GROUP BY 1""",
)
def vol_eval(spark, d):
    return E.vol_eval(P.type_px(spark, d))


@query(
    "band_eval",
    "F40",
    P.with_(
        *targets("type"),
        "bu AS MATERIALIZED (SELECT *, CASE WHEN blend > 0 THEN abs(move / (blend * sqrt(5))) END AS u FROM vx)",
        "bz AS (SELECT a.symbol, a.i, count(b.u) AS c, quantile_cont(b.u, 0.95::DOUBLE) AS q FROM bu a LEFT JOIN bu b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 509 AND a.i - 6 AND b.u IS NOT NULL WHERE a.i >= 60 AND a.move IS NOT NULL GROUP BY 1, 2)",
        "bj AS (SELECT bu.*, CASE WHEN c >= 60 THEN least(2.6, greatest(1.96, q)) ELSE 1.96 END AS z FROM bu JOIN bz USING (symbol, i))",
        "bl AS (SELECT 'cc_fixed' AS band, move, 1.96 * cc * sqrt(5) AS half FROM bj UNION ALL SELECT 'blend_fixed', move, 1.96 * blend * sqrt(5) FROM bj UNION ALL SELECT 'blend_adaptive', move, z * blend * sqrt(5) FROM bj)",
        recursive=True,
    )
    + "SELECT band, count(*) AS n, avg((abs(move) <= half)::INT) AS coverage, avg(2 * half) AS width FROM bl WHERE half IS NOT NULL GROUP BY 1",
)
def band_eval(spark, d):
    return E.band_eval(P.type_px(spark, d))


_Q = "CASE WHEN {m} > 0 AND rvar > 0 THEN rvar / ({m} * {m} * 5) - ln(rvar / ({m} * {m} * 5)) - 1 END"


@query(
    "category_vol_study",
    "F41 S8",
    P.with_(
        *targets("brand"),
        "cv AS (SELECT *, 'S' || (CAST(substr(symbol, 7) AS INTEGER) % 3) AS sector, CASE WHEN blend > 0 THEN move / (blend * sqrt(5)) END AS z FROM vx WHERE i >= 60 AND move IS NOT NULL)",
        "cg AS (SELECT sector, count(z) AS n, avg(blend) FILTER (blend > 0) AS daily_vol, kurtosis_pop(z) AS kurtosis, avg((abs(z) <= 1.96)::INT) AS coverage, quantile_cont(abs(z), 0.95::DOUBLE) AS z95, "
        + ", ".join(f"avg({_Q.format(m=m)}) AS q_{m}" for m in E.NAMES)
        + " FROM cv GROUP BY 1)",
        recursive=True,
    )
    + """SELECT sector, n, daily_vol, kurtosis, coverage, z95, least(q_cc, q_ewma, q_yz, q_blend) AS best_qlike,
 CASE least(q_cc, q_ewma, q_yz, q_blend) WHEN q_blend THEN 'blend' WHEN q_cc THEN 'cc' WHEN q_ewma THEN 'ewma' ELSE 'yz' END AS best_estimator FROM cg""",
)
def category_vol_study(spark, d):
    return E.category_vol_study(sector_px(spark, d))


XS = [
    numbered(P.px_sql("brand"), "px"),
    recur({"e55": ("close", "2.0/56"), "e89": ("close", "2.0/90"), "e204": ("close", "2.0/205"), "ef": ("close", "2.0/14"), "es": ("close", "2.0/35")}),
    f"""xs AS MATERIALIZED (SELECT b.symbol, b.ts, b.i, e55 > e89 AND e89 > e204 AND ef - es > 0 AND close > e55 AS buy, e55 < e89 AND e89 < e204 AND ef - es < 0 AND close < e55 AS sell,
 lead(close, 21) OVER (PARTITION BY b.symbol ORDER BY b.ts) / close - 1 AS fwd FROM b JOIN e USING (symbol, k))""",
    f"xw AS MATERIALIZED (SELECT *, buy AND NOT coalesce(lag(buy) OVER ({WS}), false) AS fresh, coalesce(lag(CASE WHEN buy THEN 'buy' WHEN sell THEN 'sell' ELSE 'neutral' END) OVER ({WS}), 'neutral') AS bef FROM xs WHERE i >= 209)",
]
_R = "count(*) AS n, avg((fwd >= 0.15)::INT) AS bump_rate, avg((fwd <= -0.15)::INT) AS crash_rate, avg(fwd) AS mean_fwd"


@query(
    "crossover_hit_rate",
    "F37",
    P.with_(*XS, recursive=True)
    + f"SELECT 'any' AS state, {_R} FROM xw WHERE fwd IS NOT NULL UNION ALL SELECT 'buy', {_R} FROM xw WHERE fwd IS NOT NULL AND buy UNION ALL SELECT 'fresh_buy', {_R} FROM xw WHERE fwd IS NOT NULL AND fresh",
)
def crossover_hit_rate(spark, d):
    return E.crossover_hit_rate(P.brand_px(spark, d))


@query(
    "largest_moves",
    "F37 K4",
    P.with_(*XS, recursive=True)
    + "SELECT symbol, ts AS start_ts, fwd AS move, bef AS state_before FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fwd DESC, i) AS k FROM xw WHERE fwd IS NOT NULL) WHERE k = 1",
)
def largest_moves(spark, d):
    return E.largest_moves(P.brand_px(spark, d))


DISC = [
    P.px_sql("brand"),
    P.px_sql("type", "tpx"),
    f"mk AS (SELECT ts, avg(close) AS close FROM tpx GROUP BY ts)",
    "mb AS MATERIALIZED (SELECT ts, close, lead(close, 21) OVER (ORDER BY ts) / close - 1 AS bench_21, lead(close, 63) OVER (ORDER BY ts) / close - 1 AS bench_63 FROM mk)",
    f"pb AS MATERIALIZED (SELECT symbol, ts, i, n, close, lead(close, 21) OVER ({WS}) / close - 1 AS fwd_21, lead(close, 63) OVER ({WS}) / close - 1 AS fwd_63 FROM px)",
    "tr AS (SELECT row_number() OVER () AS id, p_brand AS symbol, l_shipdate AS td, CAST(l_shipdate + INTERVAL 45 DAY AS TIMESTAMP) AS dd FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A')",
    "t1 AS (SELECT tr.*, pb.close AS entry FROM tr ASOF JOIN pb ON tr.symbol = pb.symbol AND tr.td >= pb.ts)",
    "t2 AS (SELECT t1.*, f.i AS di FROM t1 ASOF JOIN pb f ON t1.symbol = f.symbol AND t1.dd <= f.ts WHERE f.n - f.i >= 68)",
    "t3 AS MATERIALIZED (SELECT t2.id, min(b.i) AS i FROM t2 JOIN pb b ON b.symbol = t2.symbol AND b.i >= t2.di AND b.i < t2.di + 120 AND abs(b.close / t2.entry - 1) <= 0.02 GROUP BY 1)",
    "t4 AS (SELECT t2.symbol, t2.entry, b.i, b.ts, b.fwd_21, b.fwd_63 FROM t3 JOIN t2 USING (id) JOIN pb b ON b.symbol = t2.symbol AND b.i = t3.i WHERE b.fwd_63 IS NOT NULL)",
    "dd AS (SELECT DISTINCT ts FROM t4)",
    "d1 AS (SELECT dd.ts, a.ts AS bts, a.bench_21 AS b21, a.bench_63 AS b63 FROM dd ASOF LEFT JOIN mb a ON dd.ts >= a.ts)",
    "d2 AS (SELECT dd.ts, a.ts AS fts, a.bench_21 AS f21, a.bench_63 AS f63 FROM dd ASOF LEFT JOIN mb a ON dd.ts <= a.ts)",
    "d3 AS (SELECT ts, CASE WHEN fts IS NULL OR (bts IS NOT NULL AND ts - bts <= fts - ts) THEN b21 ELSE f21 END AS bench_21, CASE WHEN fts IS NULL OR (bts IS NOT NULL AND ts - bts <= fts - ts) THEN b63 ELSE f63 END AS bench_63 FROM d1 JOIN d2 USING (ts))",
    "ds AS MATERIALIZED (SELECT t4.*, bench_21, bench_63 FROM t4 JOIN d3 USING (ts) WHERE bench_63 IS NOT NULL)",
]


def purchases(spark, d):
    """Disclosed purchases derived from returned lines: the ship date is the
    trade, disclosed 45 days later."""
    from ..sources import feeds

    li = P.table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag")
    part = P.table(spark, d, "part").select("p_partkey", "p_brand")
    raw = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.col("p_brand").alias("Ticker"),
        F.col("l_shipdate").cast("timestamp").alias("TransactionDate"),
        F.lit(None).cast("timestamp").alias("DisclosureDate"),
        F.when(F.col("l_returnflag") == "A", "Purchase").otherwise("Sale").alias("Type"),
    )
    return feeds.disclosures(raw)


@query("disclosure_signals", "F38 J2 J3 J4 A15", P.with_(*DISC) + "SELECT symbol, ts, i, entry, fwd_21, fwd_63, bench_21, bench_63 FROM ds")
def disclosure_signals(spark, d):
    s = E.disclosure_signals(purchases(spark, d), P.brand_px(spark, d), P.market(P.type_px(spark, d)))
    return s.select("symbol", "ts", "i", "entry", "fwd_21", "fwd_63", "bench_21", "bench_63")


@query(
    "disclosure_return_study",
    "F38 F12",
    P.with_(*DISC)
    + " UNION ALL ".join(
        f"SELECT {h}::BIGINT AS horizon, count(*) AS n, avg(fwd_{h}) AS mean_ret, avg(bench_{h}) AS bench_ret, avg(fwd_{h} - bench_{h}) AS edge, avg(fwd_{h} - bench_{h}) / (stddev_samp(fwd_{h} - bench_{h}) / sqrt(count(*))) AS t, avg((fwd_{h} > bench_{h})::INT) AS win_vs_bench FROM ds"
        for h in (21, 63)
    ),
)
def disclosure_return_study(spark, d):
    return E.disclosure_return_study(
        E.disclosure_signals(purchases(spark, d), P.brand_px(spark, d), P.market(P.type_px(spark, d)))
    )


def candle_ctes(panel: str = "type") -> list[str]:
    hs = (5, 10, 20)
    return [
        P.px_sql(panel),
        geometry_cte(),
        events_cte(),
        "fw AS MATERIALIZED (SELECT symbol, ts, "
        + ", ".join(f"lead(close, {h}) OVER ({WS}) / close - 1 AS f{h}" for h in hs)
        + " FROM px)",
        "bu AS (" + " UNION ALL ".join(f"SELECT symbol, {h}::BIGINT AS horizon, avg((f{h} > 0)::INT) AS up FROM fw WHERE f{h} IS NOT NULL GROUP BY 1" for h in hs) + ")",
        "ccl AS (" + " UNION ALL ".join(f"SELECT e.symbol, e.name, e.bias, {h}::BIGINT AS horizon, f{h} AS f FROM cev e JOIN fw USING (symbol, ts)" for h in hs) + ")",
        """cb AS MATERIALIZED (SELECT symbol, name, bias, horizon, c AS count, s AS samples, win_rate, avg_return, win_rate - CASE WHEN bias = 'bearish' THEN 1 - up ELSE up END AS edge, up AS base_up FROM (
 SELECT symbol, name, bias, horizon, count(*) AS c, count(f) AS s, avg(CASE WHEN f IS NULL THEN NULL WHEN bias = 'bearish' THEN (f < 0)::INT ELSE (f > 0)::INT END) AS win_rate, avg(f) AS avg_return FROM ccl GROUP BY 1, 2, 3, 4)
 JOIN bu USING (symbol, horizon) WHERE c >= 5 AND s > 0)""",
    ]


@query("candle_backtest", "F3", P.with_(*candle_ctes()) + "SELECT * FROM cb")
def candle_backtest(spark, d):
    return E.candle_backtest(P.type_px(spark, d))
