"""Volatility estimators: per bar and on the newest bar."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import volatility as V
from . import panels as P
from .indicators import WS, full, recur
from .registry import query

LN2 = repr(math.log(2.0))
K20 = repr(0.34 / (1.34 + 21 / 19))

TERMS = f"""tv AS MATERIALIZED (SELECT *, ln(close / lag(close) OVER ({WS})) AS r, ln(open / lag(close) OVER ({WS})) AS ovn,
  ln(close / open) AS oc, ln(high / low) ** 2 AS pk, 0.5 * ln(high / low) ** 2 - (2 * {LN2} - 1) * ln(close / open) ** 2 AS gk,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, row_number() OVER ({WS}) AS k FROM {{src}}),
tq AS MATERIALIZED (SELECT symbol, k, r * r AS r2 FROM tv)"""


def vol_ctes(panel_sql: str, src: str) -> list[str]:
    """CTEs ending in ``vols``: every estimator per bar."""
    yz = (
        f"CASE WHEN count(ovn) OVER w20 >= 20 THEN var_samp(ovn) OVER w20 + {K20} * var_samp(oc) OVER w20 "
        f"+ (1 - {K20}) * avg(rs) OVER w20 END"
    )
    return [
        panel_sql,
        TERMS.format(src=src),
        recur({"ev": ("r2", "0.06")}, src="tq", first="k = 2", name="evs"),
        f"""vt AS MATERIALIZED (SELECT tv.*, ev, {yz} AS yzv, {full('stddev_samp', 'r', 20)} AS vol_close_to_close,
  sqrt({full('avg', 'pk', 20)} / (4 * {LN2})) AS vol_parkinson, {full('avg', 'gk', 20)} AS gkm, {full('avg', 'rs', 20)} AS rsm
  FROM tv LEFT JOIN evs USING (symbol, k) WINDOW w20 AS ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
        """vols AS MATERIALIZED (SELECT *, CASE WHEN k >= 30 THEN sqrt(ev) END AS vol_ewma,
  CASE WHEN gkm >= 0 THEN sqrt(gkm) END AS vol_garman_klass, CASE WHEN rsm >= 0 THEN sqrt(rsm) END AS vol_rogers_satchell,
  CASE WHEN yzv >= 0 THEN sqrt(yzv) END AS vol_yang_zhang,
  CASE WHEN ev IS NOT NULL THEN sqrt(greatest(0.5 * coalesce(yzv, ev) + 0.5 * ev, 1e-12)) END AS sigma FROM vt)""",
    ]


FIX = lambda s: s.replace("sqrt(CASE", "sqrt((CASE").replace("END / (4", "END) / (4")
PXV = [FIX(c) for c in vol_ctes(P.px_sql("type"), "px")]
COLS = [f"vol_{m}" for m in ("close_to_close", "ewma", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")]


@query(
    "vol_series",
    "C1 C2 C3 C4 C5 C6",
    P.with_(*PXV, recursive=True) + f"SELECT symbol, ts, {', '.join(COLS)} FROM vols",
)
def vol_series(spark, d):
    return V.series(P.type_px(spark, d), [c[4:] for c in COLS]).select("symbol", "ts", *COLS)


@query(
    "vol_variance_series",
    "C7 C8 C9",
    P.with_(*PXV, recursive=True) + "SELECT symbol, ts, ev AS ewma_var, yzv AS yz_var, sigma FROM vols",
)
def vol_variance_series(spark, d):
    x = V.with_ewma_var(V.prepared(P.type_px(spark, d)))
    return x.select("symbol", "ts", "ewma_var", V.yz_var().alias("yz_var"), V.blend().alias("sigma"))


@query(
    "vol_estimators",
    "C10 U2",
    P.with_(*PXV, recursive=True)
    + "SELECT symbol, estimator, value FROM (UNPIVOT (SELECT symbol, "
    + ", ".join(f"{c} AS {c[4:]}" for c in COLS)
    + ", sigma AS blend FROM vols WHERE i = n - 1) ON COLUMNS(* EXCLUDE symbol) INTO NAME estimator VALUE value)",
)
def vol_estimators(spark, d):
    return V.latest(P.type_px(spark, d))
