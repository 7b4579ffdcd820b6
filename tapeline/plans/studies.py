"""Event studies: every mask family through the shared harness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import windows as w
from ..operators import masks as M
from ..operators import study as S
from . import panels as P
from .indicators import RSI_EWM_SQL, WS, full, gains, recur, rsi_sma_sql
from .registry import query

PX = P.px_sql("brand")


def _lag(e: str, n: int = 1) -> str:
    return f"lag({e}, {n}) OVER ({WS})"


# feature CTEs mirrored for the oracle: three layers, as window calls cannot nest
F1 = f"""f1 AS (SELECT *, i + 1 AS k, close - lag(close) OVER ({WS}) AS d, lag(close) OVER ({WS}) AS prev,
 {', '.join(f"{full('avg', 'close', n)} AS sma{n}" for n in (5, 20, 50, 150, 200))},
 {full('max', 'close', 252)} AS hi252, {full('min', 'close', 60)} AS lo60, {full('max', 'close', 20)} AS max20,
 {full('min', 'close', 20)} AS min20, {full('max', 'close', 21)} AS roll21,
 {', '.join(f"{full('max', 'close', n, 1)} AS prior{n}" for n in (20, 21, 50, 252))},
 {full('max', 'high', 50, 1)} AS prior_high50, {full('avg', 'volume', 50)} AS volavg50,
 count(close) OVER ({WS} ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) >= 400 AS enough,
 close / {_lag('close', 126)} - 1 AS mom6, {_lag('close', 21)} / {_lag('close', 252)} - 1 AS mom12_1 FROM px)"""
F2 = """f2 AS (SELECT *, close / hi252 - 1 AS dd, coalesce(close < sma200, false) AS below200, coalesce(close > sma50, false) AS above50,
 volume / volavg50 AS vr, coalesce(close > prior21, false) AS new21, coalesce(close > prior_high50, false) AS above_level,
 (max20 - min20) / close AS tight, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM f1)"""
F3 = f"""f3 AS MATERIALIZED (SELECT *, {full('min', 'dd', 63)} AS dd_min, coalesce({_lag('above50')}, false) AS above50_b,
 coalesce({_lag('above_level')}, false) AS above_level_b, {_lag('sma200')} AS sma200_1, {_lag('sma50', 20)} AS sma50_20,
 {_lag('sma200', 21)} AS sma200_21, {_lag('sma200', 22)} AS sma200_22, {_lag('sma200', 252)} AS sma200_252, {_lag('tight')} AS tight_b,
 CASE WHEN i >= 21 THEN sum(new21::INT) OVER ({WS} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) END AS breaks21,
 max(new21::INT) OVER ({WS} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS breaks10, {_lag('roll21', 11)} AS old_level,
 {rsi_sma_sql(14)} AS rsi14_sma, {rsi_sma_sql(2)} AS rsi2_sma FROM f2)"""
RS = recur(gains(2, 14), src="f3", first="k = 2", name="rs_e")
F4 = f"f4 AS MATERIALIZED (SELECT f3.*, {RSI_EWM_SQL.format(p=2)} AS rsi2, {RSI_EWM_SQL.format(p=14)} AS rsi14 FROM f3 LEFT JOIN rs_e USING (symbol, k))"
CAL = "cal AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ci, count(*) OVER () AS cn FROM (SELECT DISTINCT ts FROM px))"
FEAT = [PX, F1, F2, F3]
FEAT_RSI = [PX, F1, F2, F3, RS, F4]

CRASH = "(dd_min <= -0.2 AND enough)"
CROSS50 = "(above50 AND NOT above50_b)"
REC200 = "(close > sma200 AND prev <= sma200_1)"
FRESH = "(new21 AND breaks21 = 0 AND enough)"
BIG = "(dd_min <= -0.4 AND enough)"
FLATUP = "(sma200 >= 0.995 * sma200_21)"
SQL_MASKS = {
    "ALL": "true",
    "R1_reclaim50": f"below200 AND {CROSS50} AND {CRASH}",
    "R2_recovering_state": f"below200 AND above50 AND {CRASH}",
    "R3_reclaim200": f"{REC200} AND {CRASH}",
    "R4_bounce_low": f"below200 AND close / lo60 - 1 >= 0.1 AND {CRASH}",
    "R5_slope50_up": f"below200 AND sma50 > sma50_20 AND {CRASH}",
    "STILL_WEAK": f"below200 AND NOT above50 AND {CRASH}",
    "V1_recover_LTuptrend": f"below200 AND above50 AND {CRASH} AND sma200 > sma200_252",
    "V2_bigDD_reclaim50": f"{BIG} AND below200 AND {CROSS50}",
    "V3_recover_RSI2_oversold": f"below200 AND above50 AND {CRASH} AND rsi2_sma < 15",
    "V4_reclaim200_slopeup": f"{REC200} AND {CRASH} AND sma200 > sma200_21",
    "V4b_reclaim200_slopeflat": f"{REC200} AND {CRASH} AND {FLATUP}",
    "V5_recover_slopeflat": f"below200 AND above50 AND {CRASH} AND {FLATUP}",
    "V6_bigDD_recover": f"{BIG} AND below200 AND above50",
    "V7_wk200up_recover": f"above_wk40 AND above50 AND {CRASH}",
    "new20": "close > prior20",
    "new50": "close > prior50",
    "new252": "close > prior252",
    "GEN_break": "new21 AND enough",
    "B1_fresh_from_base": FRESH,
    "B2_retest": "breaks10 = 1 AND abs(close / old_level - 1) < 0.02 AND close > old_level AND enough",
    "V0_plain50": "close > prior50 AND enough",
    "V1_vol50_1.5x": "close > prior50 AND vr > 1.5 AND enough",
    "V2_vol50_2x": "close > prior50 AND vr > 2.0 AND enough",
    "V3_vol_uptrend": "close > prior50 AND vr > 1.5 AND enough AND close > sma200",
    "V4_52whigh_vol": "close > prior252 AND vr > 1.5 AND enough",
    "V5_vcp": "close > prior50 AND vr > 1.5 AND enough AND tight_b < 0.1",
    "fresh_cross": "above_level AND NOT above_level_b",
    "above_state": "above_level",
    "dip_buy": "rsi2 < 15 AND close > sma200 AND enough",
    "overbought_break": f"{FRESH} AND rsi14_sma > 68",
    "calm_break": f"{FRESH} AND rsi14_sma <= 68",
    "overbought_RSI70": "rsi14 > 70",
    "extended_10pct": "close > 1.10 * sma50",
    "below_200": "close < sma200",
    "M1_tsmom_above200": "close > sma200 AND mom12_1 > 0 AND enough",
    "M3_golden_cross": "sma50 > sma200 AND enough",
    "M5_stage2_uptrend": "close > sma50 AND sma50 > sma200 AND sma50 > sma50_20 AND enough",
    "trend_template": "close > sma150 AND close > sma200 AND sma150 > sma200 AND sma50 > sma150 AND sma200 > sma200_22 AND rs > 0",
    "golden_cross": "sma50 > sma200",
    "oversold_in_uptrend": "close > sma200 AND rsi14 < 40",
    "top_relative_strength": "rs_rank >= 0.75",
}


def long_sql(names: list[str], horizons, src: str, start: int = 260, masks: dict[str, str] | None = None) -> list[str]:
    masks = masks or SQL_MASKS
    flags = ", ".join(f"coalesce({masks[n]}, false) AS m{j}" for j, n in enumerate(names))
    fwds = ", ".join(f"lead(close, {h}) OVER ({WS}) / close - 1 AS fwd_{h}" for h in horizons)
    parts = [
        f"SELECT symbol, ts, CAST({h} AS BIGINT) AS horizon, '{n}' AS signal, m{j} AS hit, "
        f"coalesce(ci >= {start} AND ci < cn - {h} AND (ci - {start}) % {h} = 0, false) AS sampled, fwd_{h} AS fwd FROM mm WHERE fwd_{h} IS NOT NULL"
        for h in horizons
        for j, n in enumerate(names)
    ]
    return [
        CAL,
        f"mm AS MATERIALIZED (SELECT symbol, ts, ci, cn, {flags}, {fwds} FROM {src} JOIN cal USING (ts))",
        "lg AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")",
    ]


def summary_sql(keys: str = "signal, horizon", pooled: str = "hit", quantiles: bool = False, src: str = "lg") -> str:
    q = ", quantile_cont(fwd, 0.5) FILTER ({p}) AS median, quantile_cont(fwd, 0.25::DOUBLE) FILTER ({p}) AS p25".format(p=pooled)
    qcols = ", median, p25" if quantiles else ""
    ks = [k.strip() for k in keys.split(",")]
    using = f"USING ({keys})"
    return f""", pool AS (SELECT {keys}, count(*) FILTER ({pooled}) AS n, avg(fwd) FILTER ({pooled}) AS mean_ret, avg((fwd > 0)::INT) FILTER ({pooled}) AS win_rate,
  avg((fwd > 0.2)::INT) FILTER ({pooled}) AS big_win_rate, avg((fwd < 0)::INT) FILTER ({pooled}) AS dud_rate, min(fwd) FILTER ({pooled}) AS worst
  {q if quantiles else ''} FROM {src} WHERE hit OR sampled GROUP BY {keys}),
pd AS (SELECT {keys}, ts, avg(fwd) FILTER (hit) - avg(fwd) FILTER (NOT hit) AS diff FROM {src} WHERE sampled GROUP BY {keys}, ts),
tt AS (SELECT {keys}, avg(diff) AS diff_mean, CASE WHEN count(diff) > 2 AND stddev_samp(diff) > 0 THEN avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) END AS t,
  count(diff) AS n_dates FROM pd GROUP BY {keys})
SELECT {', '.join('pool.' + k for k in ks)}, n, mean_ret, win_rate, big_win_rate, dud_rate, worst, n >= 20 AS powered, diff_mean, t, coalesce(n_dates, 0) AS n_dates{qcols}
FROM pool LEFT JOIN tt {using}"""


def study_sql(ctes: list[str], names: list[str], horizons, src: str, start=260, pooled="hit", quantiles=False) -> str:
    return (
        P.with_(*ctes, *long_sql(names, horizons, src, start), recursive=True)
        + summary_sql(pooled=pooled, quantiles=quantiles)
    )


def features(spark, d, rsi: bool = False):
    """The feature table of the brand panel, built once per session."""
    if rsi:
        return P.shared(spark, d, "features_rsi", lambda: M.with_rsi(features(spark, d)))
    return P.shared(spark, d, "features", lambda: M.with_features(P.brand_px(spark, d)))


RECOVERY = ["R1_reclaim50", "R2_recovering_state", "R3_reclaim200", "R4_bounce_low", "R5_slope50_up", "STILL_WEAK"]
H3 = (21, 63, 126)


@query(
    "baseline_returns",
    "F1",
    P.with_(PX, "h AS (SELECT unnest([21, 63, 126])::BIGINT AS horizon)")
    + f"""SELECT horizon, count(*) AS n, avg(f) AS mean_ret, avg((f > 0)::INT) AS win_rate, quantile_cont(f, 0.5) AS median FROM (
 SELECT 21::BIGINT AS horizon, lead(close, 21) OVER ({WS}) / close - 1 AS f FROM px UNION ALL
 SELECT 63, lead(close, 63) OVER ({WS}) / close - 1 FROM px UNION ALL SELECT 126, lead(close, 126) OVER ({WS}) / close - 1 FROM px)
 WHERE f IS NOT NULL GROUP BY horizon""",
)
def baseline_returns(spark, d):
    return S.baseline_returns(P.brand_px(spark, d), H3)


@query("recovery_signals", "F2 F4 F13 K1", study_sql(FEAT, RECOVERY, H3, "f3", quantiles=True))
def recovery_signals(spark, d):
    return S.run_study(features(spark, d), M.columns(RECOVERY), H3, quantiles=True)


@query(
    "recovering_vs_weak",
    "F5",
    P.with_(*FEAT, *long_sql(RECOVERY, (63,), "f3"), recursive=True)
    + """, w AS (SELECT symbol, ts, hit, sampled, fwd FROM lg WHERE signal = 'STILL_WEAK'),
j AS (SELECT a.signal AS pair, a.horizon, a.ts, a.fwd, a.hit AS a, w.hit AS b, a.sampled FROM lg a JOIN w USING (symbol, ts) WHERE a.signal <> 'STILL_WEAK'),
dd AS (SELECT pair, horizon, ts, avg(fwd) FILTER (a AND sampled) - avg(fwd) FILTER (b AND sampled) AS diff FROM j GROUP BY pair, horizon, ts)
SELECT j2.pair, j2.horizon, mean_a, mean_b, diff_mean, t, n_dates FROM
 (SELECT pair, horizon, avg(fwd) FILTER (a) AS mean_a, avg(fwd) FILTER (b) AS mean_b FROM j GROUP BY 1, 2) j2 JOIN
 (SELECT pair, horizon, avg(diff) AS diff_mean, CASE WHEN count(diff) > 2 THEN avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) END AS t,
  count(diff) AS n_dates FROM dd GROUP BY 1, 2) d2 USING (pair, horizon)""",
)
def recovering_vs_weak(spark, d):
    m = M.columns(RECOVERY)
    return S.mask_vs_mask(features(spark, d), {k: (m[k], m["STILL_WEAK"]) for k in RECOVERY[:-1]}, (63,))


WEEKLY = f"""wk AS (SELECT symbol, CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS TIMESTAMP) AS wts, arg_max(close, ts) AS wc
  FROM px GROUP BY 1, 2),
wm AS (SELECT symbol, wts, wc, CASE WHEN count(*) OVER w >= 40 THEN avg(wc) OVER w END AS ws FROM wk
  WINDOW w AS (PARTITION BY symbol ORDER BY wts ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
wj AS (SELECT f4.*, coalesce(wm.wc > wm.ws, false) AS wku, wm.ws AS ws FROM f4 ASOF LEFT JOIN wm ON f4.symbol = wm.symbol AND f4.ts >= wm.wts),
f5 AS MATERIALIZED (SELECT *, coalesce(lag(wku) OVER ({WS}), false) AND coalesce(close > lag(ws) OVER ({WS}), false) AS above_wk40 FROM wj)"""
VARIANTS = [n for n in M.MASKS if n.startswith("V") and ("recover" in n.lower() or "reclaim" in n or "big" in n)]


@query("recovery_variants", "F14", study_sql([*FEAT_RSI, WEEKLY], VARIANTS, (63, 126), "f5", quantiles=True))
def recovery_variants(spark, d):
    x = P.shared(spark, d, "features_weekly", lambda: M.with_weekly_trend(features(spark, d, rsi=True)))
    return S.run_study(x, M.columns(VARIANTS), (63, 126), quantiles=True)


# fixed values: the named date buckets (shifted to the span of the given data)
BUCKETS = [
    ("all", "1990-01-01", "2099-01-01"),
    ("early", "1995-01-01", "1996-12-31"),
    ("middle", "1997-01-01", "1998-12-31"),
    ("late", "1999-01-01", "2099-01-01"),
    ("pre_cut", "1990-01-01", "1998-05-31"),
    ("post_cut", "1998-06-01", "2099-01-01"),
]
SPLIT = ["R2_recovering_state", "R5_slope50_up", "STILL_WEAK"]


def bucket_frame(spark):
    df = spark.createDataFrame(BUCKETS, "bucket string, lo string, hi string")
    return df.select("bucket", F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi"))


@query(
    "regime_split",
    "F15 J6 K3",
    P.with_(
        *FEAT,
        *long_sql(SPLIT, (63,), "f3"),
        "bk(bucket, lo, hi) AS (VALUES " + ", ".join(f"('{b}', TIMESTAMP '{x}', TIMESTAMP '{y}')" for b, x, y in BUCKETS) + ")",
        "lb AS (SELECT lg.*, bucket FROM lg JOIN bk ON ts >= lo AND ts <= hi)",
        recursive=True,
    )
    + summary_sql("signal, bucket", src="lb"),
)
def regime_split(spark, d):
    return S.regime_split(features(spark, d), M.columns(SPLIT), 63, bucket_frame(spark))


@query(
    "firing_by_year",
    "F15",
    P.with_(*FEAT, *long_sql(SPLIT, (63,), "f3"), recursive=True)
    + "SELECT signal, year(ts) AS year, count(*) AS n FROM lg WHERE hit GROUP BY 1, 2",
)
def firing_by_year(spark, d):
    return S.firing_by_year(features(spark, d), M.columns(SPLIT), 63)


BREAKS = ["new20", "new50", "new252"]


@query("breakout_study", "F16", study_sql(FEAT, BREAKS, H3, "f3", pooled="hit AND sampled", quantiles=True))
def breakout_study(spark, d):
    return S.run_study(features(spark, d), M.columns(BREAKS), H3, pooled_on_sample=True, quantiles=True)


PATTERNS = ["GEN_break", "B1_fresh_from_base", "B2_retest"]


@query("breakout_patterns", "F17", study_sql(FEAT, PATTERNS, H3, "f3"))
def breakout_patterns(spark, d):
    return S.run_study(features(spark, d), M.columns(PATTERNS), H3)


VOLUME = ["V0_plain50", "V1_vol50_1.5x", "V2_vol50_2x", "V3_vol_uptrend", "V4_52whigh_vol", "V5_vcp"]


@query("volume_breakouts", "F18", study_sql(FEAT, VOLUME, (21, 63), "f3"))
def volume_breakouts(spark, d):
    return S.run_study(features(spark, d), M.columns(VOLUME), (21, 63))


@query("resistance_masks", "F19", study_sql(FEAT, ["fresh_cross", "above_state"], (5, 21, 63), "f3"))
def resistance_masks(spark, d):
    return S.run_study(features(spark, d), M.columns(["fresh_cross", "above_state"]), (5, 21, 63))


SHORT = ["ALL", "B1_fresh_from_base", "V1_vol50_1.5x", "dip_buy"]


@query("short_hold_study", "F21", study_sql(FEAT_RSI, SHORT, (1, 2, 3, 5), "f4"))
def short_hold_study(spark, d):
    return S.run_study(features(spark, d, True), M.columns(SHORT), (1, 2, 3, 5))


@query("overbought_split", "F22", study_sql(FEAT_RSI, ["overbought_break", "calm_break"], (3, 5), "f4"))
def overbought_split(spark, d):
    return S.run_study(features(spark, d, True), M.columns(["overbought_break", "calm_break"]), (3, 5))


SELL = ["overbought_RSI70", "extended_10pct", "below_200"]


@query(
    "sell_signal_study",
    "F23",
    "SELECT *, CASE WHEN mean_ret < 0 AND t < -2 THEN 'predicts_down' ELSE 'no_edge' END AS verdict FROM ("
    + study_sql(FEAT_RSI, SELL, (5, 21), "f4", start=210, pooled="hit AND sampled")
    + ")",
)
def sell_signal_study(spark, d):
    out = S.run_study(features(spark, d, True), M.columns(SELL), (5, 21), start=210, pooled_on_sample=True)
    down = w.flag((F.col("mean_ret") < 0) & (F.col("t") < -2))
    return out.withColumn("verdict", F.when(down, "predicts_down").otherwise("no_edge"))


MOM = ["M1_tsmom_above200", "M3_golden_cross", "M5_stage2_uptrend"]


@query("momentum_study", "F24", study_sql(FEAT, MOM, (21, 63, 126), "f3"))
def momentum_study(spark, d):
    return S.run_study(features(spark, d), M.columns(MOM), (21, 63, 126))


BENCH_SQL = f"""{P.px_sql('type', 'tpx')},
mk AS (SELECT ts, avg(close) AS bench FROM tpx GROUP BY ts),
fr AS MATERIALIZED (SELECT f4.*, bench FROM f4 ASOF LEFT JOIN mk ON f4.ts >= mk.ts),
fq AS MATERIALIZED (SELECT *, close / lag(close, 126) OVER ({WS}) - bench / lag(bench, 126) OVER ({WS}) AS rs FROM fr),
f6 AS MATERIALIZED (SELECT *, CASE WHEN rs IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY rs) + (count(*) OVER (PARTITION BY ts, rs) - 1) / 2.0)
  / count(rs) OVER (PARTITION BY ts) END AS rs_rank FROM fq)""".replace("ORDER BY rs)", "ORDER BY rs NULLS LAST)")
PICK = ["ALL", "trend_template", "golden_cross", "oversold_in_uptrend", "top_relative_strength"]


def picking_panel(spark, d):
    build = lambda: M.with_relative(features(spark, d, True), P.market(P.type_px(spark, d)))
    return P.shared(spark, d, "features_rs", build)


@query(
    "picking_study",
    "F26",
    study_sql([*FEAT_RSI, BENCH_SQL], PICK, (63,), "f6", start=210, pooled="hit AND sampled"),
)
def picking_study(spark, d):
    return S.run_study(picking_panel(spark, d), M.columns(PICK), (63,), start=210, pooled_on_sample=True)


@query(
    "relative_strength_rank",
    "K5 S9",
    P.with_(*FEAT_RSI, BENCH_SQL, recursive=True) + "SELECT symbol, ts, rs, rs_rank FROM f6 WHERE rs IS NOT NULL",
)
def relative_strength_rank(spark, d):
    return picking_panel(spark, d).where(F.col("rs").isNotNull()).select("symbol", "ts", "rs", "rs_rank")
