"""Portfolio queries: accounts are nation x market segment, positions are net
quantities of orders; part types play funds whose constituents are brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import portfolio as PF
from ..operators import regimes as R
from ..operators import trades as TR
from ..operators import tradeplan as TP
from ..sources.feeds import norm_sector
from . import panels as P
from .indicators import RSI_WILDER_SQL, WS, full, gains, numbered, recur
from .registry import query
from .regimes import AGE, ALIGN, MTF, STAGE, at, tail
from .trades import BASE, METRIC, plan_ctes, walk

PB, PT = P.px_sql("brand", "bpx"), P.px_sql("type", "tpx")


def holdings(spark, d):
    return P.shared(spark, d, "holdings", lambda: _holdings(spark, d))


def _holdings(spark, d):
    li = P.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    part = P.table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = P.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = P.nations(spark, d).select("n_nationkey", F.col("symbol").alias("n_name"))
    # parts, orders and customers grow with the lines, so none of them is broadcast; their few columns meet first
    own = o.join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = li.join(part.hint("merge"), li["l_partkey"] == part["p_partkey"]).join(own.hint("merge"), li["l_orderkey"] == F.col("o_orderkey"))
    account = F.concat_ws("/", "n_name", "c_mktsegment")
    symbol = F.when(F.col("p_size") <= 25, F.col("p_type")).otherwise(F.col("p_brand"))
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    g = x.groupBy(account.alias("account"), symbol.alias("symbol")).agg(
        F.sum(q).alias("shares"), (60.37 + 800 * F.avg("l_discount")).alias("avg_cost")
    )
    return g.where(F.col("shares") > 0)


def accounts(spark, d):
    c = P.table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    n = P.nations(spark, d).select("n_nationkey", F.col("symbol").alias("n_name"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.concat_ws("/", "n_name", "c_mktsegment").alias("account")).agg(
        F.sum("c_acctbal").alias("cash")
    )


def fund_holdings(spark, d):
    return P.shared(spark, d, "fund_holdings", lambda: _fund_holdings(spark, d))


def _fund_holdings(spark, d):
    li = P.table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    part = P.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    g = li.join(part.hint("merge"), li["l_partkey"] == part["p_partkey"]).groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("q"))
    t = g.groupBy("p_type").agg(F.sum("q").alias("t"))
    return g.join(t, "p_type").select(F.col("p_type").alias("fund"), F.col("p_brand").alias("underlying"), (0.85 * F.col("q") / F.col("t")).alias("weight"))


def both_px(spark, d):
    return P.shared(spark, d, "both_px", lambda: P.brand_px(spark, d).unionByName(P.type_px(spark, d)))


def prices(spark, d):
    return both_px(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))


def values(spark, d):
    return P.shared(spark, d, "values", lambda: PF.value_holdings(holdings(spark, d), prices(spark, d), fund_holdings(spark, d)))


HOLD = [
    PB,
    PT,
    "ux AS MATERIALIZED (SELECT * FROM bpx UNION ALL SELECT * FROM tpx)",
    "pr AS (SELECT symbol, arg_max(close, ts) AS price FROM ux GROUP BY symbol)",
    """hd AS MATERIALIZED (SELECT * FROM (SELECT n_name || '/' || c_mktsegment AS account, CASE WHEN p_size <= 25 THEN p_type ELSE p_brand END AS symbol,
 sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS shares, 60.37 + 800 * avg(l_discount) AS avg_cost FROM lineitem JOIN part ON l_partkey = p_partkey
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE shares > 0)""",
    "ac AS MATERIALIZED (SELECT n_name || '/' || c_mktsegment AS account, sum(c_acctbal) AS cash FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)",
    """fh AS MATERIALIZED (SELECT p_type AS fund, p_brand AS underlying, 0.85 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY p_type) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    """vh AS MATERIALIZED (SELECT account, hd.symbol, shares, avg_cost, price, shares * price AS value, shares * avg_cost AS cost, price / avg_cost - 1 AS gain,
 hd.symbol IN (SELECT fund FROM fh) AS is_fund, CASE WHEN price IS NULL THEN 'no data' END AS error FROM hd LEFT JOIN pr USING (symbol))""",
    """sm AS MATERIALIZED (SELECT account, cash, coalesce(invested, 0) AS invested, coalesce(invested, 0) + cash AS total_value, coalesce(icost, 0) + cash AS total_cost, coalesce(invested, 0) - coalesce(icost, 0) AS total_gain,
 CASE WHEN icost > 0 THEN invested / icost - 1 END AS total_gain_rate, coalesce(positions, 0) AS positions, coalesce(failed, 0) AS failed FROM ac LEFT JOIN
 (SELECT account, sum(value) AS invested, sum(cost) AS icost, count(*) FILTER (value <> 0) AS positions, count(error) AS failed FROM vh GROUP BY 1) USING (account))""",
]


@query("value_holdings", "H1", P.with_(*HOLD) + "SELECT vh.*, coalesce(value / total_value, 0) AS weight FROM vh JOIN sm USING (account)")
def value_holdings(spark, d):
    return PF.with_weights(values(spark, d), accounts(spark, d))


@query("account_summary", "H11", P.with_(*HOLD) + "SELECT * FROM sm")
def account_summary(spark, d):
    return PF.account_summary(values(spark, d), accounts(spark, d))


CLASSES = {"Brand#2": "Brand#1"}
LOOK = [
    *HOLD,
    """lx AS (SELECT account, CASE WHEN underlying IS NULL THEN vh.symbol WHEN underlying = 'Brand#2' THEN 'Brand#1' ELSE underlying END AS underlying, vh.symbol AS source, value * coalesce(weight, 1) AS value
 FROM vh LEFT JOIN fh ON fh.fund = vh.symbol WHERE value <> 0)""",
    "lk AS MATERIALIZED (SELECT account, underlying, sum(value) AS value, count(DISTINCT source) AS places, max((source = underlying)::INT) = 1 AND count(DISTINCT source) > 1 AS stacked FROM lx GROUP BY 1, 2)",
    "rs AS (SELECT account, sum(value * greatest(0, 1 - cv)) AS residual FROM vh JOIN (SELECT fund, sum(weight) AS cv FROM fh GROUP BY 1) ON fund = symbol GROUP BY 1)",
    """fsx AS (SELECT fund, sector, sum(w) AS weight FROM (SELECT fund, 'S' || (CAST(substr(underlying, 7) AS INTEGER) % 3) AS sector, weight AS w FROM fh) GROUP BY 1, 2)""",
    """sc AS MATERIALIZED (SELECT account, sector, sum(v) AS value FROM (SELECT account, f.sector, value * f.weight / sum(f.weight) OVER (PARTITION BY account, vh.symbol) AS v FROM vh JOIN fsx f ON f.fund = vh.symbol WHERE value <> 0
 UNION ALL SELECT account, 'S' || (CAST(substr(symbol, 7) AS INTEGER) % 3), value FROM vh WHERE NOT is_fund AND value <> 0) GROUP BY 1, 2)""",
]


def exposure(spark, d):
    return PF.look_through(values(spark, d), fund_holdings(spark, d), CLASSES)


@query("look_through", "H3 J5 K2", P.with_(*LOOK) + "SELECT * FROM lk")
def look_through(spark, d):
    return exposure(spark, d)


MEGA = [f"Brand#{i}" for i in range(1, 9)]


@query(
    "concentration_index",
    "H4",
    P.with_(
        *LOOK,
        "t3 AS (SELECT account, sum(value) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY value DESC, underlying) AS k FROM lk) WHERE k <= 3 GROUP BY 1)",
        f"cg AS (SELECT account, sum(value) AS named, sum(value * value) AS sq, coalesce(sum(value) FILTER (underlying IN ({', '.join(repr(m) for m in MEGA)})), 0) AS mega FROM lk GROUP BY 1)",
    )
    + """SELECT account, sq / (named + coalesce(residual, 0)) ** 2 AS hhi, (named + coalesce(residual, 0)) ** 2 / sq AS effective_n, top3 / total_value AS top3_share, mega / total_value AS megacap_share,
 coalesce(residual, 0) / total_value AS residual_share FROM cg LEFT JOIN rs USING (account) JOIN t3 USING (account) JOIN sm USING (account)""",
)
def concentration_index(spark, d):
    v, f = values(spark, d), fund_holdings(spark, d)
    return PF.concentration(PF.look_through(v, f, CLASSES), PF.residuals(v, f), accounts(spark, d), v, MEGA)


def sector_frames(spark, d):
    sec = lambda c: F.concat(F.lit("S"), F.substring(c, 7, 9).cast("int") % 3)
    fs = fund_holdings(spark, d).groupBy("fund", sec("underlying").alias("sector")).agg(F.sum("weight").alias("weight"))
    own = P.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("sector", sec("symbol"))
    return fs, own


@query("sector_exposure", "H3", P.with_(*LOOK) + "SELECT * FROM sc")
def sector_exposure(spark, d):
    return PF.sector_exposure(values(spark, d), *sector_frames(spark, d))


@query(
    "exposure_flags",
    "H5",
    P.with_(*LOOK)
    + """SELECT account, 'name' AS kind, underlying AS item, value / total_value AS weight FROM lk JOIN sm USING (account) WHERE value / total_value > 0.1
 UNION ALL SELECT account, 'sector', sector, value / total_value FROM sc JOIN sm USING (account) WHERE value / total_value > 0.4""",
)
def exposure_flags(spark, d):
    v, a = values(spark, d), accounts(spark, d)
    return PF.exposure_flags(PF.look_through(v, fund_holdings(spark, d), CLASSES), PF.sector_exposure(v, *sector_frames(spark, d)), a, v)


def themes(spark, d):
    b = P.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    k = F.substring("symbol", 7, 9).cast("int")
    return b.select("symbol", F.explode(F.filter(F.array(F.when(k <= 8, F.lit("low")), F.when(k % 2 == 0, F.lit("even"))), lambda t: t.isNotNull())).alias("theme"))


@query(
    "theme_caps",
    "H6",
    P.with_(
        *LOOK,
        "th AS (SELECT DISTINCT p_brand AS symbol, 'low' AS theme FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) <= 8 UNION ALL SELECT DISTINCT p_brand, 'even' FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0)",
    )
    + "SELECT account, theme, sum(value) / any_value(total_value) AS weight, sum(value) / any_value(total_value) > 0.4 AS over FROM lk JOIN th ON th.symbol = underlying JOIN sm USING (account) GROUP BY 1, 2",
)
def theme_caps(spark, d):
    v = values(spark, d)
    return PF.theme_caps(PF.look_through(v, fund_holdings(spark, d), CLASSES), themes(spark, d), accounts(spark, d), v)


def fees(spark, d):
    p = P.table(spark, d, "part").groupBy(F.col("p_type").alias("symbol")).agg((F.avg("p_size") / 100.0).alias("fee_pct"))
    return p


@query(
    "fee_drag",
    "H7",
    P.with_(
        *HOLD,
        "fe AS (SELECT p_type AS symbol, avg(p_size) / 100.0 AS fee FROM part GROUP BY 1)",
        "fv AS (SELECT account, sum(value) AS inv, coalesce(sum(value * fee), 0) / sum(value) AS f FROM vh LEFT JOIN fe USING (symbol) GROUP BY 1)",
    )
    + "SELECT account, f AS blended_fee_pct, inv * f / 100 AS annual_cost, inv * (1.07 ** 10 - (1.07 - f / 100) ** 10) AS drag_10y, inv * (1.07 ** 30 - (1.07 - f / 100) ** 30) AS drag_30y, inv * (1.07 ** 30 - 1.06 ** 30) AS one_pct_30y FROM fv WHERE inv > 0",
)
def fee_drag(spark, d):
    return PF.fee_drag(values(spark, d), fees(spark, d))


RET = [
    *HOLD,
    f"ur AS MATERIALIZED (SELECT symbol, ts, close / lag(close) OVER ({WS}) - 1 AS r FROM ux)",
    "uc AS (SELECT symbol, count(r) AS c FROM ur GROUP BY 1)",
    "un AS (SELECT account, count(DISTINCT ts) AS nd FROM vh JOIN ur USING (symbol) WHERE value > 0 GROUP BY 1)",
    "kp AS MATERIALIZED (SELECT account, symbol, value / sum(value) OVER (PARTITION BY account) AS w, count(*) OVER (PARTITION BY account) AS k FROM (SELECT vh.account, vh.symbol, value FROM vh JOIN uc USING (symbol) JOIN un ON un.account = vh.account WHERE value > 0 AND c >= 0.8 * nd))",
    "prt AS MATERIALIZED (SELECT account, ts, sum(w * r) AS ret FROM kp JOIN ur USING (symbol) WHERE r IS NOT NULL GROUP BY account, ts, k HAVING count(*) = k)",
]


@query("portfolio_returns", "H8", P.with_(*RET) + "SELECT * FROM prt")
def portfolio_returns(spark, d):
    return P.shared(spark, d, "portfolio_returns", lambda: PF.portfolio_returns(values(spark, d), both_px(spark, d)))


@query(
    "portfolio_vol",
    "H9",
    P.with_(*RET, "pv AS (SELECT account, stddev_samp(ret) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC) AS k FROM prt) WHERE k <= 252 GROUP BY 1)")
    + "SELECT account, sd * sqrt(5) AS weekly_vol, sd * sqrt(252) AS annual_vol, 1.96 * sd * sqrt(5) AS typical_week FROM pv",
)
def portfolio_vol(spark, d):
    return PF.portfolio_vol(portfolio_returns(spark, d))


@query(
    "portfolio_drawdown",
    "H10",
    P.with_(
        *RET,
        "e1 AS (SELECT *, product(1 + ret) OVER (PARTITION BY account ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq, count(*) OVER (PARTITION BY account) AS n FROM prt)",
        "e2 AS MATERIALIZED (SELECT *, max(eq) OVER (PARTITION BY account ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM e1 WHERE n >= 60)",
        "e3 AS (SELECT account, min(eq / pk - 1) AS max_drawdown, arg_min(ts, (eq / pk - 1, ts)) AS trough_ts, max(n) AS n_returns FROM e2 GROUP BY 1)",
        "e4 AS (SELECT e3.*, (SELECT arg_max(ts, (eq, -epoch_us(ts))) FROM e2 WHERE e2.account = e3.account AND ts <= trough_ts) AS peak_ts FROM e3)",
    )
    + "SELECT account, max_drawdown, trough_ts, n_returns, peak_ts, (SELECT min(ts) FROM e2 WHERE e2.account = e4.account AND ts > trough_ts AND eq >= (SELECT eq FROM e2 z WHERE z.account = e4.account AND z.ts = e4.peak_ts)) AS recovered_ts FROM e4",
)
def portfolio_drawdown(spark, d):
    return PF.portfolio_drawdown(portfolio_returns(spark, d))


LIGHT = [
    *plan_ctes(5),
    AGE,
    *MTF[1:],
    ALIGN,
    STAGE,
    f"lb AS MATERIALIZED (SELECT *, i + 1 AS k, close - lag(close) OVER ({WS}) AS d FROM ag)",
    recur(gains(14), src="lb", first="k = 2", name="lge"),
    f"lr AS (SELECT lb.symbol, lb.ts, {RSI_WILDER_SQL.format(p=14)} AS rsi FROM lb JOIN lge USING (symbol, k))",
    f"l0 AS (SELECT symbol, count(*) AS bars, {at(0)} AS price, {tail('avg', 50)} AS m50, {tail('avg', 200)} AS m200 FROM ag GROUP BY 1)",
    "l1 AS (SELECT l0.*, (SELECT arg_max(rsi, ts) FROM lr WHERE lr.symbol = l0.symbol AND rsi IS NOT NULL) AS rsi, CASE WHEN alignment IN ('strong_up', 'mostly_up') THEN 'up' WHEN alignment IN ('strong_down', 'mostly_down') THEN 'down' ELSE 'mixed' END AS trend FROM l0 LEFT JOIN al USING (symbol))",
    """lrd AS MATERIALIZED (SELECT l1.symbol, l1.price, CASE WHEN bars >= 400 THEN l1.price < m200 END AS below_200, CASE WHEN bars >= 400 AND l1.price < m200 THEN l1.price > m50 END AS recovering,
 CASE WHEN bars >= 400 THEN st.stage END AS stage, trend, rsi, target_ret, stop_ret, p_profit_intraperiod,
 CASE WHEN trend = 'down' THEN 'review' WHEN rsi >= 70 THEN 'trim' WHEN trend = 'up' AND rsi <= 45 THEN 'dip' ELSE 'hold' END AS bucket FROM l1 LEFT JOIN st USING (symbol) LEFT JOIN plan USING (symbol))""",
]


@query("light_read", "H2", P.with_(*LIGHT, recursive=True) + "SELECT * FROM lrd")
def light_read(spark, d):
    return PF.light_read(P.type_px(spark, d))


ATR_SQL = f"""tq1 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({WS})), abs(low - lag(close) OVER ({WS}))) AS tr FROM ux),
at0 AS MATERIALIZED (SELECT symbol, arg_max(a, ts) AS atr FROM (SELECT symbol, ts, {full('avg', 'tr', 14)} AS a FROM tq1) GROUP BY 1)"""


def latest_atr(spark, d):
    return I.atr(both_px(spark, d)).groupBy("symbol").agg(F.max_by("atr", "ts").alias("atr"))


def sized(spark, d):
    v, a = values(spark, d), accounts(spark, d)
    t = PF.account_summary(v, a).select("account", F.col("total_value").alias("account_value"))
    return v.join(t, "account").select("account", "symbol", "account_value", "shares", F.col("price").alias("entry"))


SIZE = [*HOLD, ATR_SQL, "sz AS MATERIALIZED (SELECT account, vh.symbol, total_value AS av, shares, price AS entry, atr, coalesce(atr >= price * 1e-4, false) AS ok FROM vh JOIN sm USING (account) LEFT JOIN at0 USING (symbol))"]


@query(
    "atr_size",
    "H12",
    P.with_(*SIZE)
    + """SELECT account, symbol, entry, atr, ok AS available, CASE WHEN ok THEN entry - 2 * atr END AS stop_price, CASE WHEN ok THEN 2 * atr END AS risk_per_share, CASE WHEN ok THEN av * 0.01 END AS dollar_risk,
 CASE WHEN ok THEN av * 0.01 / (2 * atr) END AS shares, CASE WHEN ok THEN av * 0.01 / (2 * atr) * entry / av END AS position_share FROM sz""",
)
def atr_size(spark, d):
    return PF.atr_size(sized(spark, d).drop("shares"), latest_atr(spark, d))


@query(
    "portfolio_heat",
    "H14",
    P.with_(*SIZE)
    + "SELECT account, sum(CASE WHEN atr > 0 AND entry - 2 * atr > 0 THEN shares * 2 * atr ELSE 0 END) AS open_risk, sum(CASE WHEN atr > 0 AND entry - 2 * atr > 0 THEN shares * 2 * atr ELSE 0 END) / max(av) AS heat, sum(CASE WHEN atr > 0 AND entry - 2 * atr > 0 THEN shares * 2 * atr ELSE 0 END) / max(av) > 0.06 AS hot FROM sz GROUP BY account",
)
def portfolio_heat(spark, d):
    p = sized(spark, d).join(latest_atr(spark, d), "symbol").withColumn("stop", F.col("entry") - 2.0 * F.col("atr"))
    return PF.portfolio_heat(p)


@query(
    "kelly",
    "H13",
    P.with_(*BASE, *walk("dip", "dt"), f"m AS (SELECT symbol, {METRIC}, avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret <= 0) AS payoff FROM dt GROUP BY symbol)", "k AS (SELECT *, greatest(0.01, payoff) AS b FROM m)", recursive=True)
    + "SELECT symbol, n, win_rate, payoff, (b * win_rate - (1 - win_rate)) / b AS full_kelly, greatest(0, (b * win_rate - (1 - win_rate)) / b * 0.25) AS fractional_kelly FROM k",
)
def kelly(spark, d):
    t = TR.dip_trades(P.type_px(spark, d))
    r = F.col("ret")
    m = t.groupBy("symbol").agg(
        F.count(r).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), (F.avg(F.when(r > 0, r)) / -F.avg(F.when(r <= 0, r))).alias("payoff")
    )
    return m.withColumns(PF.kelly(F.col("win_rate"), F.col("payoff")))


STG = STAGE.replace("FROM ag GROUP", "FROM uag GROUP")


@query(
    "health_check",
    "H15",
    P.with_(*HOLD, "uag AS MATERIALIZED (SELECT *, n - 1 - i AS age FROM ux)", STG)
    + "SELECT account, vh.symbol, CASE WHEN gain <= -0.08 THEN 'stop' WHEN stage = 'stage4' THEN 'broken' ELSE 'ok' END AS status, value >= 0.03 * sum(value) OVER (PARTITION BY account) AS big FROM vh LEFT JOIN st USING (symbol) WHERE value <> 0",
)
def health_check(spark, d):
    return PF.health_check(values(spark, d), R.trend_stage(both_px(spark, d)))


@query(
    "exit_alerts",
    "H16",
    P.with_(
        *HOLD,
        "uag AS MATERIALIZED (SELECT *, n - 1 - i AS age FROM ux)",
        f"bl AS (SELECT symbol, price < m200 AND nb >= 400 AS b, price > m50 AS rec FROM (SELECT symbol, count(*) AS nb, {at(0)} AS price, {tail('avg', 50)} AS m50, {tail('avg', 200)} AS m200 FROM uag GROUP BY 1))",
        "xa AS (SELECT account, vh.symbol, gain, b, rec FROM vh LEFT JOIN bl USING (symbol) WHERE value <> 0)",
    )
    + "SELECT account, symbol, CASE WHEN rec THEN 'recovering' ELSE 'risk' END AS kind FROM xa WHERE b UNION ALL SELECT account, symbol, 'loss' FROM xa WHERE gain <= -0.12 UNION ALL SELECT account, symbol, 'gain' FROM xa WHERE gain >= 0.25",
)
def exit_alerts(spark, d):
    return PF.exit_alerts(values(spark, d), PF.light_read(both_px(spark, d)))


@query(
    "norm_sector",
    "A20 K13",
    """SELECT p_partkey, CASE raw WHEN 'technology' THEN 'Technology' WHEN 'financial_services' THEN 'Financial Services' WHEN '' THEN 'Other' WHEN 'realestate' THEN 'Real Estate' ELSE upper(raw[1]) || lower(raw[2:]) END AS sector FROM (
 SELECT p_partkey, CASE WHEN p_size < 10 THEN 'technology' WHEN p_size < 20 THEN 'financial_services' WHEN p_size < 25 THEN '' WHEN p_size < 30 THEN 'realestate' ELSE p_type END AS raw FROM part)""",
)
def norm_sector_query(spark, d):
    s = F.col("p_size")
    raw = F.when(s < 10, "technology").when(s < 20, "financial_services").when(s < 25, "").when(s < 30, "realestate").otherwise(F.col("p_type"))
    return P.table(spark, d, "part").select("p_partkey", norm_sector(raw).alias("sector"))
