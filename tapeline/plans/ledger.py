"""Ledger queries: calls extracted from every bar, logged once and scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import evaluations as E
from ..operators import ledger as L
from ..operators import levels as LV
from ..operators import masks as M
from . import panels as P
from .evaluations import XS
from .indicators import WS
from .levels import BUCKET_P
from .registry import query
from .studies import FEAT_RSI, SQL_MASKS, features


def verdicts(spark, d):
    """Per-bar verdict columns of the brand panel."""
    x = features(spark, d, True)
    x = x.withColumn("__ath", F.max("close").over(w.history(shift=1)))
    cross = E.crossover_states(P.brand_px(spark, d)).select(
        "symbol", "ts", F.when(F.col("fresh"), F.lit("up")).alias("crossover_direction")
    )
    p = LV.ath_bucket(w.ratio("__ath", "close") - 1.0)["p_reach"]
    v = x.select(
        "symbol",
        "ts",
        F.col("close").alias("price"),
        F.when(w.flag(M.MASKS["fresh_cross"]()), "fresh_breakout").alias("state"),
        p.alias("p_reach_ath_63d"),
        w.flag(M.MASKS["dip_buy"]()).alias("dip_active"),
    )
    return v.join(cross, ["symbol", "ts"], "left")


V = [
    *FEAT_RSI,
    "b AS MATERIALIZED (SELECT symbol, ts, close, i, i + 1 AS k FROM px)",
    *XS[1:],
    f"ah AS (SELECT symbol, ts, max(close) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / close - 1 AS dist FROM px)",
    f"""lg AS MATERIALIZED (SELECT f4.ts, upper(f4.symbol) AS symbol, 'resistance_breakout' AS signal_type, 'up' AS direction, CAST({BUCKET_P.format(x='dist')} AS DOUBLE) AS predicted_p, close AS entry_price, 'fresh_breakout' AS note
 FROM f4 JOIN ah USING (symbol, ts) WHERE {SQL_MASKS['fresh_cross']}
 UNION ALL SELECT ts, upper(symbol), 'dip_buy', 'up', NULL, close, NULL FROM f4 WHERE {SQL_MASKS['dip_buy']}
 UNION ALL SELECT xw.ts, upper(xw.symbol), 'ema_macd_crossover', 'up', NULL, b.close, NULL FROM xw JOIN b ON b.symbol = xw.symbol AND b.ts = xw.ts WHERE fresh)""",
]
COLS = "ts, symbol, signal_type, direction, predicted_p, entry_price, note"


def ledger(spark, d):
    """The logged table: doubled input collapses to one row per key."""
    return P.shared(spark, d, "ledger", lambda: L.log_signals(L.extract_signals(verdicts(spark, d))))


@query("extract_signals", "I1 K10", P.with_(*V, recursive=True) + f"SELECT {COLS} FROM lg")
def extract_signals(spark, d):
    return L.extract_signals(verdicts(spark, d))


@query("log_signals", "I2 A22 J7", P.with_(*V, recursive=True) + f"SELECT {COLS} FROM lg WHERE NOT (ts < TIMESTAMP '1998-01-01' AND signal_type = 'dip_buy')")
def log_signals(spark, d):
    """Polling twice adds nothing; rows already in the ledger stay out."""
    new = L.extract_signals(verdicts(spark, d))
    old = new.where((F.col("ts") < "1998-01-01") & (F.col("signal_type") == "dip_buy"))
    return L.log_signals(new.unionByName(new), old)


SCORE = [
    *V,
    P.px_sql("type", "tpx"),
    "mk AS (SELECT ts, avg(close) AS close FROM tpx GROUP BY ts)",
    "mb AS MATERIALIZED (SELECT ts, " + ", ".join(f"lead(close, {h}) OVER (ORDER BY ts) / close - 1 AS bench_{h}" for h in L.HORIZONS) + " FROM mk)",
    "ob AS MATERIALIZED (SELECT upper(symbol) AS symbol, ts, close AS entry_close, " + ", ".join(f"lead(close, {h}) OVER ({WS}) / close - 1 AS ret_{h}" for h in L.HORIZONS) + " FROM px)",
    "s1 AS (SELECT lg.*, ob.entry_close, " + ", ".join(f"ob.ret_{h}" for h in L.HORIZONS) + " FROM lg ASOF LEFT JOIN ob ON lg.symbol = ob.symbol AND lg.ts <= ob.ts)",
    "sc AS MATERIALIZED (SELECT s1.*, " + ", ".join(f"CASE WHEN ret_{h} IS NOT NULL THEN bench_{h} END AS bench_{h}" for h in L.HORIZONS) + " FROM s1 ASOF LEFT JOIN mb ON s1.ts <= mb.ts)",
]


def scored(spark, d):
    bars = P.brand_px(spark, d).withColumn("symbol", F.upper("symbol"))
    return P.shared(spark, d, "ledger_scored", lambda: L.score_forward(ledger(spark, d), bars, P.market(P.type_px(spark, d))))


@query("score_forward", "I3 J3", P.with_(*SCORE, recursive=True) + f"SELECT {COLS}, entry_close, ret_5, ret_21, ret_63, bench_5, bench_21, bench_63 FROM sc")
def score_forward(spark, d):
    return scored(spark, d)


@query(
    "type_scoreboard",
    "I4",
    P.with_(*SCORE, recursive=True)
    + "SELECT signal_type, count(ret_21) AS n, avg((ret_21 > 0)::INT) AS win_rate, avg(ret_21) AS avg_dir_return, avg(ret_21 - bench_21) AS avg_edge, count(ret_21 - bench_21) AS n_benchmarked FROM sc GROUP BY 1 HAVING count(ret_21) > 0",
)
def type_scoreboard(spark, d):
    return L.type_scoreboard(scored(spark, d))


def curve_sql(h: int) -> str:
    band = "CASE " + " ".join(f"WHEN predicted_p >= {lo} AND predicted_p < {hi} THEN '{lab}'" for lo, hi, lab in L.BANDS) + " END"
    return (
        P.with_(*SCORE, recursive=True)
        + f"SELECT band, count(*) AS n, avg(predicted_p) AS mean_predicted, avg((ret_{h} > 0)::INT) AS realized_up_rate FROM (SELECT *, {band} AS band FROM sc) WHERE band IS NOT NULL AND ret_{h} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"
    )


@query("calibration_curve", "I5 J6", curve_sql(21))
def calibration_curve(spark, d):
    return L.calibration_curve(scored(spark, d))


@query("calibration_curve_matched", "I5", curve_sql(63))
def calibration_curve_matched(spark, d):
    return L.calibration_curve(scored(spark, d), 63)


@query("ledger_recent", "I6 K8 K9", P.with_(*V, recursive=True) + f"SELECT {COLS} FROM lg ORDER BY ts DESC, symbol, signal_type LIMIT 50")
def ledger_recent(spark, d):
    return L.recent(ledger(spark, d), 50)
