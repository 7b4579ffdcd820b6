"""Ordered primitives and indicators on raw panel bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..functions import windows as w
from ..operators import indicators as I
from . import panels as P
from .registry import query

T = P.bars_sql("type")
B_ = P.bars_sql("brand")
PX = P.px_sql("brand")
WS = "PARTITION BY symbol ORDER BY ts"


def full(fn: str, c: str, n: int, shift: int = 0) -> str:
    """DuckDB text of a full-window rolling aggregate."""
    fr = f"OVER ({WS} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    return f"CASE WHEN count({c}) {fr} >= {n} THEN {fn}({c}) {fr} END"


@query(
    "returns",
    "B1 B2",
    P.with_(T)
    + f"""SELECT symbol, ts, close - lag(close) OVER w AS diff, close / lag(close) OVER w - 1 AS pct_change,
  ln(close / lag(close) OVER w) AS log_ret, lag(close, 5) OVER w AS lag5,
  lead(close, 5) OVER w / close - 1 AS fwd_5, lead(close, 21) OVER w / close - 1 AS fwd_21
FROM bars WINDOW w AS ({WS})""",
)
def returns(spark, d):
    b = P.type_bars(spark, d)
    return b.select(
        "symbol",
        "ts",
        (F.col("close") - w.lag("close")).alias("diff"),
        w.ret("close", w.lag("close")).alias("pct_change"),
        w.ln(w.ratio("close", w.lag("close"))).alias("log_ret"),
        w.lag("close", 5).alias("lag5"),
        w.ret(w.lead("close", 5), "close").alias("fwd_5"),
        w.ret(w.lead("close", 21), "close").alias("fwd_21"),
    )


@query(
    "sma",
    "B3",
    P.with_(T)
    + f"""SELECT symbol, ts, {full('avg', 'close', 20)} AS sma20, {full('avg', 'close', 50)} AS sma50,
  {full('avg', 'close', 200)} AS sma200 FROM bars""",
)
def sma(spark, d):
    return P.type_bars(spark, d).select("symbol", "ts", *[I.sma("close", n).alias(f"sma{n}") for n in (20, 50, 200)])


def numbered(panel_sql: str, src: str = "bars") -> str:
    return (
        f"{panel_sql},\nb AS MATERIALIZED (SELECT *, row_number() OVER ({WS}) AS k, "
        f"close - lag(close) OVER ({WS}) AS d FROM {src})"
    )


def recur(cols: dict[str, tuple[str, str]], src: str = "b", first: str = "k = 1", name: str = "e") -> str:
    """DuckDB recursive text: ``cols`` maps a name to (input, alpha)."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in cols.items())
    step = ", ".join(f"p.{n} + ({_q(x)} - p.{n}) * ({a})" for n, (x, a) in cols.items())
    return (
        f"{name} AS (SELECT symbol, k, {seed} FROM {src} WHERE {first}\n UNION ALL SELECT q.symbol, q.k, {step} "
        f"FROM {name} p JOIN {src} q ON q.symbol = p.symbol AND q.k = p.k + 1)"
    )


def _q(expr: str) -> str:
    import re

    return re.sub(r"\b(close|d|r2|m|x|g)\b", r"q.\1", expr)


@query(
    "ema",
    "B4",
    P.with_(
        numbered(T),
        recur({"ema12": ("close", "2.0/13"), "ema55": ("close", "2.0/56"), "ema204": ("close", "2.0/205")}),
        recursive=True,
    )
    + "SELECT b.symbol, b.ts, ema12, ema55, ema204 FROM b JOIN e USING (symbol, k)",
)
def ema(spark, d):
    b = P.type_bars(spark, d)
    return scan.ema(b, {"ema12": ("close", 12), "ema55": ("close", 55), "ema204": ("close", 204)}).select(
        "symbol", "ts", "ema12", "ema55", "ema204"
    )


_GL = {"ag{p}": ("greatest(d, 0)", "1.0/{p}"), "al{p}": ("greatest(-d, 0)", "1.0/{p}")}


def gains(*periods: int) -> dict[str, tuple[str, str]]:
    return {k.format(p=p): (x, a.format(p=p)) for p in periods for k, (x, a) in _GL.items()}


RSI_WILDER_SQL = (
    "CASE WHEN k <= {p} THEN NULL WHEN ag{p} = 0 AND al{p} = 0 THEN 50.0 WHEN ag{p} = 0 THEN 0.0 "
    "WHEN al{p} = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag{p} / al{p}) END"
)
RSI_EWM_SQL = "CASE WHEN al{p} <> 0 THEN 100 - 100 / (1 + ag{p} / al{p}) END"


@query(
    "rsi_wilder",
    "B5",
    P.with_(numbered(T), recur(gains(14), first="k = 2"), recursive=True)
    + f"SELECT b.symbol, b.ts, {RSI_WILDER_SQL.format(p=14)} AS rsi FROM b LEFT JOIN e USING (symbol, k)",
)
def rsi_wilder(spark, d):
    return I.rsi(P.type_bars(spark, d)).select("symbol", "ts", "rsi")


@query(
    "rsi_ewm",
    "B5",
    P.with_(numbered(T), recur(gains(14, 2), first="k = 2"), recursive=True)
    + f"SELECT b.symbol, b.ts, {RSI_EWM_SQL.format(p=14)} AS rsi14, {RSI_EWM_SQL.format(p=2)} AS rsi2 "
    "FROM b LEFT JOIN e USING (symbol, k)",
)
def rsi_ewm(spark, d):
    x = I.rsi(P.type_bars(spark, d), "rsi14", 14, "ewm")
    return I.rsi(x, "rsi2", 2, "ewm").select("symbol", "ts", "rsi14", "rsi2")


def rsi_sma_sql(n: int) -> str:
    return (
        f"CASE WHEN {full('avg', 'dn', n)} <> 0 THEN 100 - 100 / (1 + ({full('avg', 'up', n)}) / "
        f"({full('avg', 'dn', n)})) END"
    )


@query(
    "rsi_sma",
    "B5",
    P.with_(numbered(T), "g AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM b)")
    .replace("greatest(d, 0) AS up", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up")
    .replace("greatest(-d, 0) AS dn", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn")
    + f"SELECT symbol, ts, {rsi_sma_sql(14)} AS rsi14, {rsi_sma_sql(2)} AS rsi2 FROM g",
)
def rsi_sma(spark, d):
    x = I.rsi(P.type_bars(spark, d), "rsi14", 14, "sma")
    return I.rsi(x, "rsi2", 2, "sma").select("symbol", "ts", "rsi14", "rsi2")


def macd_ctes(src: str, fast: int, slow: int, sig: int) -> list[str]:
    return [
        src,
        recur({"ef": ("close", f"2.0/{fast + 1}"), "es": ("close", f"2.0/{slow + 1}")}),
        "ml AS MATERIALIZED (SELECT symbol, k, ef - es AS m, ef, es FROM e)",
        recur({"sg": ("m", f"2.0/{sig + 1}")}, src="ml", name="s"),
    ]


@query(
    "macd",
    "B6",
    P.with_(*macd_ctes(numbered(T), 12, 26, 9), recursive=True)
    + "SELECT b.symbol, b.ts, m AS macd, sg AS macd_signal, m - sg AS macd_hist FROM b JOIN ml USING (symbol, k) "
    "JOIN s USING (symbol, k)",
)
def macd(spark, d):
    return I.macd(P.type_bars(spark, d)).select("symbol", "ts", "macd", "macd_signal", "macd_hist")


@query(
    "macd_fibonacci",
    "B6",
    P.with_(*macd_ctes(numbered(T), 13, 34, 9), recursive=True)
    + "SELECT b.symbol, b.ts, m AS macd, sg AS macd_signal, m - sg AS macd_hist FROM b JOIN ml USING (symbol, k) "
    "JOIN s USING (symbol, k)",
)
def macd_fibonacci(spark, d):
    return I.macd(P.type_bars(spark, d), 13, 34, 9).select("symbol", "ts", "macd", "macd_signal", "macd_hist")


@query(
    "bollinger",
    "B7",
    P.with_(T)
    + f"""SELECT symbol, ts, {full('avg', 'close', 20)} AS bb_mid,
  ({full('avg', 'close', 20)}) + 2 * ({full('stddev_samp', 'close', 20)}) AS bb_upper,
  ({full('avg', 'close', 20)}) - 2 * ({full('stddev_samp', 'close', 20)}) AS bb_lower FROM bars""",
)
def bollinger(spark, d):
    return I.bollinger(P.type_bars(spark, d)).select("symbol", "ts", "bb_mid", "bb_upper", "bb_lower")


ALL_CTES = [
    numbered(T),
    recur({"ema12": ("close", "2.0/13"), "ema26": ("close", "2.0/27")}),
    "ml AS MATERIALIZED (SELECT symbol, k, ema12 - ema26 AS m FROM e)",
    recur({"sg": ("m", "2.0/10")}, src="ml", name="s"),
    recur(gains(14), first="k = 2", name="gl"),
    f"""ind AS (SELECT b.symbol, b.ts, b.k, close, volume, {full('avg', 'close', 20)} AS sma20, {full('avg', 'close', 50)} AS sma50,
  ema12, ema26, {RSI_WILDER_SQL.format(p=14)} AS rsi, m AS macd, sg AS macd_signal, m - sg AS macd_hist,
  {full('avg', 'close', 20)} AS bb_mid,
  ({full('avg', 'close', 20)}) + 2 * ({full('stddev_samp', 'close', 20)}) AS bb_upper,
  ({full('avg', 'close', 20)}) - 2 * ({full('stddev_samp', 'close', 20)}) AS bb_lower
 FROM b JOIN e USING (symbol, k) JOIN ml USING (symbol, k) JOIN s USING (symbol, k) LEFT JOIN gl USING (symbol, k))""",
]
ALL_COLS = [
    "sma20", "sma50", "ema12", "ema26", "rsi", "macd", "macd_signal", "macd_hist", "bb_mid", "bb_upper", "bb_lower"
]


@query(
    "compute_all",
    "B9",
    P.with_(*ALL_CTES, recursive=True) + f"SELECT symbol, ts, close, {', '.join(ALL_COLS)} FROM ind",
)
def compute_all(spark, d):
    return I.compute_all(P.type_bars(spark, d)).select("symbol", "ts", "close", *ALL_COLS)


@query(
    "latest_snapshot",
    "B8",
    P.with_(*ALL_CTES, recursive=True)
    + "SELECT symbol, "
    + ", ".join(
        f"arg_max({c}, ts) FILTER ({c} IS NOT NULL) AS {c}" for c in ["close", "sma20", "sma50", "rsi", "macd", "macd_signal"]
    )
    + " FROM ind GROUP BY symbol",
)
def latest_snapshot(spark, d):
    cols = ["close", "sma20", "sma50", "rsi", "macd", "macd_signal"]
    return I.latest_snapshot(I.compute_all(P.type_bars(spark, d)), cols)


@query(
    "rolling_extremes",
    "B10 B11",
    P.with_(T)
    + f"""SELECT symbol, ts, {full('max', 'close', 50, 1)} AS prior_high50, {full('min', 'close', 50, 1)} AS prior_low50,
  {full('stddev_samp', 'close', 20)} AS sd20, {full('sum', 'volume', 20)} AS vol20,
  count(close) OVER ({WS} ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) >= 400 AS mature FROM bars""",
)
def rolling_extremes(spark, d):
    return P.type_bars(spark, d).select(
        "symbol",
        "ts",
        w.roll(F.max, "close", 50, 1).alias("prior_high50"),
        w.roll(F.min, "close", 50, 1).alias("prior_low50"),
        w.roll(F.stddev_samp, "close", 20).alias("sd20"),
        w.roll(F.sum, "volume", 20).alias("vol20"),
        (F.count("close").over(w.trailing(400)) >= 400).alias("mature"),
    )


@query(
    "cumulative",
    "B12",
    P.with_(PX, f"r AS (SELECT symbol, ts, close, close / lag(close) OVER ({WS}) - 1 AS r FROM px)")
    + f"""SELECT symbol, ts, sum(coalesce(r, 0)) OVER w AS cum_sum, product(1 + coalesce(r, 0)) OVER w AS cum_prod,
  max(close) OVER w AS cum_max FROM r WINDOW w AS ({WS} ROWS UNBOUNDED PRECEDING)""",
)
def cumulative(spark, d):
    x = P.brand_px(spark, d).withColumn("r", F.coalesce(w.ret("close", w.lag("close")), F.lit(0.0)))
    return x.select(
        "symbol",
        "ts",
        F.sum("r").over(w.history()).alias("cum_sum"),
        I.cum_return("r").alias("cum_prod"),
        F.max("close").over(w.history()).alias("cum_max"),
    )


OBV_CTE = f"""ob AS (SELECT *, sum(s) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS obv FROM (
  SELECT *, sign(coalesce(close - lag(close) OVER ({WS}), 0)) * coalesce(volume, 0) AS s FROM bars))"""


@query("obv", "B13", P.with_(T, OBV_CTE) + "SELECT symbol, ts, CAST(obv AS DOUBLE) AS obv FROM ob")
def obv(spark, d):
    return I.obv(P.type_bars(spark, d)).select("symbol", "ts", "obv")


@query(
    "obv_trend",
    "B14",
    P.with_(
        T,
        OBV_CTE,
        "t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS a FROM ob)",
        "g AS (SELECT symbol, regr_slope(obv, -a) / avg(abs(obv)) AS s FROM t WHERE a <= 20 GROUP BY symbol)",
    )
    + "SELECT symbol, s AS obv_slope, CASE WHEN s > 0.01 THEN 'rising' WHEN s < -0.01 THEN 'falling' ELSE 'flat' END "
    "AS obv_trend FROM g",
)
def obv_trend(spark, d):
    return I.obv_trend(P.type_bars(spark, d))


TR_CTE = f"""tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({WS})), abs(low - lag(close) OVER ({WS})))
 AS tr FROM bars)"""


@query("atr", "B15", P.with_(T, TR_CTE) + f"SELECT symbol, ts, {full('avg', 'tr', 14)} AS atr FROM tr")
def atr(spark, d):
    return I.atr(P.type_bars(spark, d)).select("symbol", "ts", "atr")


def partial(fn: str, c: str, n: int, need: int) -> str:
    fr = f"OVER ({WS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {fr} >= {need} THEN {fn}({c}) {fr} END"


@query(
    "volume_ratio",
    "B16",
    P.with_(T)
    + f"""SELECT symbol, ts, volume / ({full('avg', 'volume', 50)}) AS vr_full,
  volume / ({partial('avg', 'volume', 50, 20)}) AS vr_min20, volume / ({partial('avg', 'volume', 5, 3)}) AS vr5_min3 FROM bars""",
)
def volume_ratio(spark, d):
    return P.type_bars(spark, d).select(
        "symbol",
        "ts",
        I.volume_ratio(50).alias("vr_full"),
        I.volume_ratio(50, 20).alias("vr_min20"),
        I.volume_ratio(5, 3).alias("vr5_min3"),
    )


TREND_SQL = """SELECT symbol, count(*) AS bars, 100 * regr_slope(close, i) / avg(close) AS slope_pct_per_bar,
  regr_r2(close, i) AS r2, regr_intercept(close, i) AS fit_start,
  regr_intercept(close, i) + regr_slope(close, i) * (count(*) - 1) AS fit_end,
  CASE WHEN 100 * regr_slope(close, i) / avg(close) > 0.05 THEN 'uptrend'
       WHEN 100 * regr_slope(close, i) / avg(close) < -0.05 THEN 'downtrend' ELSE 'sideways' END AS direction
FROM {src} GROUP BY symbol"""


@query("lin_trend", "B17", P.with_(PX) + TREND_SQL.format(src="(SELECT symbol, close, i - (n - 252) AS i FROM px WHERE n - i <= 252)"))
def lin_trend(spark, d):
    tail = P.brand_px(spark, d).withColumn("__a", w.bars_ago()).where(F.col("__a") < 252)
    return I.lin_trend(tail)


@query(
    "pct_rank_of_latest",
    "B18 B22",
    P.with_(PX, f"e AS (SELECT *, close / ({full('avg', 'close', 50)}) - 1 AS ext FROM px)")
    + """SELECT symbol, CASE WHEN count(ext) > 100 THEN 100.0 * count(*) FILTER (ext <= now) / count(ext) END AS pct_rank
FROM (SELECT *, max(CASE WHEN i = n - 1 THEN ext END) OVER (PARTITION BY symbol) AS now FROM e WHERE n - i <= 504)
GROUP BY symbol""",
)
def pct_rank_of_latest(spark, d):
    x = P.brand_px(spark, d).withColumn("ext", w.ret("close", I.sma("close", 50)))
    return I.pct_rank_of_latest(x, "ext")


@query(
    "drawdown",
    "B19",
    P.with_(PX)
    + f"SELECT symbol, ts, close / ({full('max', 'close', 252)}) - 1 AS dd252, close / ({full('max', 'close', 63)}) - 1 AS dd63 FROM px",
)
def drawdown(spark, d):
    return P.brand_px(spark, d).select(
        "symbol",
        "ts",
        w.ret("close", w.roll(F.max, "close", 252)).alias("dd252"),
        w.ret("close", w.roll(F.max, "close", 63)).alias("dd63"),
    )


@query(
    "cross_up",
    "B20",
    P.with_(
        PX,
        f"m AS (SELECT *, coalesce(({full('avg', 'close', 20)}) > ({full('avg', 'close', 50)}), false) AS up FROM px)",
    )
    + f"SELECT symbol, ts FROM (SELECT symbol, ts, up, lag(up) OVER ({WS}) AS p FROM m) WHERE up AND NOT coalesce(p, false)",
)
def cross_up(spark, d):
    x = P.brand_px(spark, d).withColumn("a", I.sma("close", 20)).withColumn("b", I.sma("close", 50))
    return x.where(w.flag(F.col("a") > F.col("b")) | F.lit(True)).withColumn(
        "x", I.cross_up(F.col("a"), F.col("b"))
    ).where("x").select("symbol", "ts")


@query(
    "recent_cross",
    "B20",
    P.with_(
        PX,
        f"m AS (SELECT symbol, ts, n - 1 - i AS ago, sign(close - avg(close) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS s, i FROM px)",
        f"c AS (SELECT *, lag(s) OVER ({WS}) AS p FROM m)",
        "h AS (SELECT symbol, arg_min(s, ago) AS s, min(ago) AS ago, max(ts) AS ts FROM c WHERE s <> 0 AND p <> 0 AND s <> p AND ago < 90 GROUP BY symbol)",
    )
    + """SELECT symbol, CASE WHEN h.s > 0 THEN 'up' WHEN h.s < 0 THEN 'down' END AS cross_dir, h.ago AS cross_bars_ago,
 h.ts AS cross_ts FROM (SELECT DISTINCT symbol FROM px) LEFT JOIN h USING (symbol)""",
)
def recent_cross(spark, d):
    x = P.brand_px(spark, d).withColumn("ma", F.avg("close").over(w.trailing(20)))
    return I.recent_cross(x, "close", "ma")


@query(
    "warm_mask",
    "B21",
    P.with_(T) + f"SELECT symbol, ts, count(close) OVER ({WS} ROWS UNBOUNDED PRECEDING) > 209 AS warm FROM bars",
)
def warm_mask(spark, d):
    return P.type_bars(spark, d).select("symbol", "ts", (F.count("close").over(w.history()) > 209).alias("warm"))


@query(
    "momentum",
    "B23",
    P.with_(T)
    + f"""SELECT symbol, ts, close / lag(close, 126) OVER w - 1 AS mom6, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom12_1
FROM bars WINDOW w AS ({WS})""",
)
def momentum(spark, d):
    return P.type_bars(spark, d).select(
        "symbol",
        "ts",
        w.ret("close", w.lag("close", 126)).alias("mom6"),
        w.ret(w.lag("close", 21), w.lag("close", 252)).alias("mom12_1"),
    )


STEP_SQL = "CASE WHEN {p} < 20 THEN 1.0 WHEN {p} < 100 THEN 5.0 WHEN {p} < 500 THEN 10.0 ELSE 50.0 END"


@query(
    "round_level",
    "B24",
    P.with_(PX, f"s AS (SELECT symbol, ts, close, CAST({STEP_SQL.format(p='close')} AS DOUBLE) AS step FROM px)")
    + "SELECT symbol, ts, step, floor(close / step) * step + step AS level FROM s",
)
def round_level(spark, d):
    return P.brand_px(spark, d).select(
        "symbol", "ts", I.round_step(F.col("close")).alias("step"), I.round_level(F.col("close")).alias("level")
    )


@query(
    "base_range",
    "B25",
    P.with_(PX, f"r AS (SELECT symbol, ts, (({full('max', 'close', 20)}) - ({full('min', 'close', 20)})) / close AS rng FROM px)")
    + f"SELECT symbol, ts, rng, lag(rng) OVER ({WS}) AS prior_rng FROM r",
)
def base_range(spark, d):
    x = P.brand_px(spark, d).withColumn("rng", I.base_range(20))
    return x.select("symbol", "ts", "rng", w.lag("rng").alias("prior_rng"))


@query(
    "slope_of_ma",
    "B26",
    P.with_(PX, f"m AS (SELECT symbol, ts, {full('avg', 'close', 200)} AS ma FROM px)")
    + f"""SELECT symbol, ts, ma > lag(ma, 21) OVER w AS up_21, ma >= 0.995 * lag(ma, 21) OVER w AS flat_up_21,
 ma > lag(ma, 252) OVER w AS up_252, ma / lag(ma, 20) OVER w - 1 AS slope_20 FROM m WINDOW w AS ({WS})""",
)
def slope_of_ma(spark, d):
    x = P.brand_px(spark, d).withColumn("ma", I.sma("close", 200))
    return x.select(
        "symbol",
        "ts",
        (F.col("ma") > w.lag("ma", 21)).alias("up_21"),
        (F.col("ma") >= 0.995 * w.lag("ma", 21)).alias("flat_up_21"),
        (F.col("ma") > w.lag("ma", 252)).alias("up_252"),
        w.ret("ma", w.lag("ma", 20)).alias("slope_20"),
    )
