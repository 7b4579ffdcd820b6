"""Forecast queries.  Model outputs have no SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..functions import windows as w
from . import panels as P
from .evaluations import targets
from .indicators import WS, full
from .registry import query
from .volatility import FIX, vol_ctes

PX = P.px_sql("type")


@query(
    "lag_features",
    "G1",
    P.with_(
        PX,
        f"r AS (SELECT *, ln(close / lag(close) OVER ({WS})) AS r FROM px)",
        "f AS (SELECT symbol, ts, "
        + ", ".join(f"lag(r, {k}) OVER ({WS}) AS ret_lag{k}" for k in range(1, 11))
        + f", {full('avg', 'r', 5, 1)} AS roll_mean5, {full('stddev_samp', 'r', 5, 1)} AS roll_std5, {full('avg', 'r', 10, 1)} AS roll_mean10, lag(close, 1) OVER ({WS}) / lag(close, 11) OVER ({WS}) - 1 AS mom10, lead(r) OVER ({WS}) AS target FROM r)",
    )
    + "SELECT * FROM f WHERE ret_lag10 IS NOT NULL AND target IS NOT NULL",
)
def lag_features(spark, d):
    return FC.lag_features(P.type_px(spark, d)).dropna(subset=[*FC.FEATURES, "target"]).select("symbol", "ts", *FC.FEATURES, "target")


@query("fit_gbt", "G2")
def fit_gbt(spark, d):
    return FC.fit_report(P.type_px(spark, d), trees=10)


@query("recursive_forecast", "G3 G5")
def recursive_forecast(spark, d):
    return FC.forecast(P.type_px(spark, d), h=5, trees=10)


@query(
    "adaptive_z",
    "G4",
    P.with_(
        *targets("type"),
        "az AS (SELECT symbol, count(*) FILTER (blend > 0 AND n - 1 - i BETWEEN 5 AND 508) AS moves, arg_max(blend, ts) FILTER (blend IS NOT NULL) AS sigma, quantile_cont(abs(move / (blend * sqrt(5))), 0.95::DOUBLE) FILTER (blend > 0 AND n - 1 - i BETWEEN 5 AND 508) AS q FROM vx GROUP BY 1)",
        recursive=True,
    )
    + "SELECT symbol, moves, sigma, CASE WHEN moves >= 60 THEN least(2.6, greatest(1.96, q)) ELSE 1.96 END AS z FROM az",
)
def adaptive_z(spark, d):
    return FC.adaptive_z(P.type_px(spark, d), 5)


@query(
    "forecast_band",
    "G5 G8",
    P.with_(*[FIX(c) for c in vol_ctes(PX, "px")], recursive=True)
    + "SELECT symbol, ts, s AS step, close * exp(-1.96 * sigma * sqrt(s)) AS lower, close * exp(1.96 * sigma * sqrt(s)) AS upper FROM vols, (SELECT unnest([1, 5, 10])::BIGINT AS s) WHERE sigma > 0",
)
def forecast_band(spark, d):
    from ..operators import volatility as V

    x = V.with_blend(P.type_px(spark, d)).where("sigma > 0")
    x = x.withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 5, 10)])))
    lo, hi = FC.band(F.col("close"), F.col("sigma"), F.lit(1.96), F.col("step"), 0.0)
    return x.select("symbol", "ts", "step", lo.alias("lower"), hi.alias("upper"))


@query(
    "future_dates",
    "G6 K12",
    P.with_(P.bars_sql("type"), "l AS (SELECT symbol, CAST(max(ts) AS DATE) AS d FROM bars GROUP BY 1)", "c AS (SELECT symbol, d + k AS f FROM l, (SELECT unnest(range(1, 40))::INTEGER AS k))")
    + "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY f) AS step, CAST(f AS TIMESTAMP) AS ts FROM c WHERE isodow(f) <= 5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY f) <= 10",
)
def future_dates(spark, d):
    return FC.future_dates(P.type_bars(spark, d), 10)


@query(
    "future_dates_hourly",
    "G6",
    P.with_(
        P.bars_sql("event"),
        "g AS (SELECT symbol, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 86400e6 AS g FROM bars)",
        "m AS (SELECT symbol, max(ts) AS l, quantile_cont(g, 0.5::DOUBLE) AS s FROM g GROUP BY 1)",
    )
    + "SELECT symbol, k AS step, make_timestamp(epoch_us(l) + CAST(round(s * k * 86400e6) AS BIGINT)) AS ts FROM m, (SELECT unnest(range(1, 6)) AS k)",
)
def future_dates_hourly(spark, d):
    return FC.future_dates(P.event_bars(spark, d), 5, "1h")


@query("track_record", "G7")
def track_record(spark, d):
    return FC.track_record(P.type_px(spark, d), trees=5)


@query(
    "persistence_baseline",
    "G8",
    P.with_(PX, f"p AS (SELECT symbol, close, lead(close, 5) OVER ({WS}) AS a FROM px)") + "SELECT symbol, count(*) AS n, avg(abs(close - a) / a) AS naive_mae FROM p WHERE a IS NOT NULL GROUP BY 1",
)
def persistence_baseline(spark, d):
    return FC.persistence(P.type_px(spark, d), 5)


@query("walkforward_eval", "F44")
def walkforward_eval(spark, d):
    return FC.walkforward_eval(P.type_px(spark, d), trees=10)


@query("holdout_eval", "F45")
def holdout_eval(spark, d):
    return FC.holdout_eval(P.type_px(spark, d), "1999-06-30", 2, trees=10)


@query("month_oos_eval", "F46")
def month_oos_eval(spark, d):
    return FC.month_oos_eval(P.type_px(spark, d), "1999-05", trees=5)


@query("weekly_direction_eval", "F47")
def weekly_direction_eval(spark, d):
    return FC.weekly_direction_eval(P.type_px(spark, d), 10, trees=5)
