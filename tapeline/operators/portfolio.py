"""Portfolio analytics for many accounts in one job.

Totals are aggregations joined back rather than windows over an account, so an
account with a third of all positions combines map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import windows as w
from . import indicators as I
from . import regimes as R
from . import tradeplan as TP

SINGLE_CAP = 0.10
THEME_CAP = 0.40
GROWTH = 0.07


def value_holdings(holdings: DataFrame, prices: DataFrame, funds: DataFrame) -> DataFrame:
    """Price, value, cost, gain and fund flag per position; a symbol without a
    price is kept with ``error``."""
    schemas.require(holdings, schemas.HOLDINGS, "holdings")
    f = funds.select(F.col("fund").alias("symbol"), F.lit(True).alias("__f")).distinct()
    x = holdings.join(prices.select("symbol", "price"), "symbol", "left").join(f, "symbol", "left")
    v = F.col("shares") * F.col("price")
    has = F.col("avg_cost") > 0
    return x.select(
        "account",
        "symbol",
        "shares",
        "avg_cost",
        "price",
        v.alias("value"),
        F.when(has & F.col("price").isNotNull(), F.col("shares") * F.col("avg_cost")).alias("cost"),
        F.when(has, F.col("price") / F.col("avg_cost") - 1.0).alias("gain"),
        F.coalesce("__f", F.lit(False)).alias("is_fund"),
        F.when(F.col("price").isNull(), "no data").alias("error"),
    )


def account_summary(values: DataFrame, accounts: DataFrame) -> DataFrame:
    g = values.groupBy("account").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("invested"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("invested_cost"),
        F.count(F.when(F.col("value") != 0, 1)).alias("positions"),
        F.count("error").alias("failed"),
    )
    x = accounts.join(g, "account", "left").fillna(0)
    return x.select(
        "account",
        "cash",
        "invested",
        (F.col("invested") + F.col("cash")).alias("total_value"),
        (F.col("invested_cost") + F.col("cash")).alias("total_cost"),
        (F.col("invested") - F.col("invested_cost")).alias("total_gain"),
        F.when(F.col("invested_cost") > 0, F.col("invested") / F.col("invested_cost") - 1.0).alias("total_gain_rate"),
        "positions",
        "failed",
    )


def with_weights(values: DataFrame, accounts: DataFrame) -> DataFrame:
    t = account_summary(values, accounts).select("account", "total_value")
    return values.join(t, "account").withColumn("weight", F.coalesce(w.ratio("value", "total_value"), F.lit(0.0))).drop("total_value")


def look_through(values: DataFrame, fund_holdings: DataFrame, share_classes: dict[str, str] | None = None) -> DataFrame:
    """Exposure rows (account, underlying, value, places, stacked): funds are
    replaced by their reported constituents, share classes merge, direct
    positions stay."""
    v = values.where(F.col("value") != 0)
    owned = v.join(fund_holdings.withColumnRenamed("fund", "symbol"), "symbol", "left")
    name = F.coalesce("underlying", "symbol")
    if share_classes:
        merge = F.create_map(*[F.lit(x) for kv in share_classes.items() for x in kv])
        name = F.when(F.col("underlying").isNotNull(), F.coalesce(F.try_element_at(merge, F.col("underlying")), F.col("underlying"))).otherwise(F.col("symbol"))
    x = owned.select(
        "account",
        name.alias("underlying"),
        F.col("symbol").alias("source"),
        (F.col("value") * F.coalesce("weight", F.lit(1.0))).alias("value"),
    )
    x = x.groupBy("account", "underlying", "source").agg(F.sum("value").alias("value"))
    g = x.groupBy("account", "underlying").agg(
        F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("places"),
        F.max((F.col("source") == F.col("underlying")).cast("int")).alias("__own"),
    )
    return g.withColumn("stacked", (F.col("__own") == 1) & (F.col("places") > 1)).drop("__own")


def residuals(values: DataFrame, fund_holdings: DataFrame) -> DataFrame:
    """Fund value no reported constituent covers, per account."""
    cover = fund_holdings.groupBy("fund").agg(F.sum("weight").alias("covered")).withColumnRenamed("fund", "symbol")
    left = F.sum(F.col("value") * F.greatest(F.lit(0.0), 1.0 - F.col("covered")))
    return values.join(cover, "symbol").groupBy("account").agg(left.alias("residual"))


def concentration(exposure: DataFrame, residual: DataFrame, accounts: DataFrame, values: DataFrame, mega: list[str] | None = None) -> DataFrame:
    """HHI over invested money (cash outside, the residual inside the
    denominator), effective number of names, top-3 and mega-cap shares."""
    top = Window.partitionBy("account").orderBy(F.desc("value"), "underlying")
    first3 = exposure.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= 3)
    first3 = first3.groupBy("account").agg(F.sum("value").alias("top3"))
    big = F.col("underlying").isin(mega) if mega else F.lit(False)
    g = exposure.groupBy("account").agg(
        F.sum("value").alias("named"),
        F.sum(F.col("value") * F.col("value")).alias("sq"),
        F.coalesce(F.sum(F.when(big, F.col("value"))), F.lit(0.0)).alias("mega"),
    )
    t = account_summary(values, accounts).select("account", "total_value")
    x = g.join(residual, "account", "left").join(first3, "account").join(t, "account")
    inv = F.col("named") + F.coalesce("residual", F.lit(0.0))
    hhi = w.ratio("sq", inv * inv)
    return x.select(
        "account",
        hhi.alias("hhi"),
        w.ratio(F.lit(1.0), hhi).alias("effective_n"),
        w.ratio("top3", "total_value").alias("top3_share"),
        w.ratio("mega", "total_value").alias("megacap_share"),
        w.ratio(F.coalesce("residual", F.lit(0.0)), "total_value").alias("residual_share"),
    )


def sector_exposure(values: DataFrame, fund_sectors: DataFrame, symbol_sectors: DataFrame) -> DataFrame:
    """Value by sector: funds by their normalised sector weights (or one label
    when unknown), single names by their own."""
    tot = fund_sectors.groupBy("fund").agg(F.sum("weight").alias("__t"))
    fs = fund_sectors.join(tot, "fund").select(F.col("fund").alias("symbol"), F.col("sector").alias("__fs"), w.ratio("weight", "__t").alias("__w"))
    x = values.where(F.col("value") != 0).join(fs, "symbol", "left").join(symbol_sectors.select("symbol", F.col("sector").alias("__ss")), "symbol", "left")
    sector = F.coalesce("__fs", F.when(F.col("is_fund"), "Diversified fund"), "__ss", F.lit("Other"))
    return x.groupBy("account", sector.alias("sector")).agg(F.sum(F.col("value") * F.coalesce("__w", F.lit(1.0))).alias("value"))


def exposure_flags(exposure: DataFrame, sectors: DataFrame, accounts: DataFrame, values: DataFrame) -> DataFrame:
    """Names over 10% and sectors over 40% of the whole account."""
    t = account_summary(values, accounts).select("account", "total_value")
    n = exposure.select("account", F.lit("name").alias("kind"), F.col("underlying").alias("item"), "value", F.lit(SINGLE_CAP).alias("cap"))
    s = sectors.select("account", F.lit("sector").alias("kind"), F.col("sector").alias("item"), "value", F.lit(THEME_CAP).alias("cap"))
    x = n.unionByName(s).join(t, "account").withColumn("weight", w.ratio("value", "total_value"))
    return x.where(F.col("weight") > F.col("cap")).select("account", "kind", "item", "weight")


def theme_caps(exposure: DataFrame, themes: DataFrame, accounts: DataFrame, values: DataFrame) -> DataFrame:
    """Theme weights on look-through exposure and whether they pass the cap."""
    t = account_summary(values, accounts).select("account", "total_value")
    g = exposure.join(themes, exposure["underlying"] == themes["symbol"]).groupBy("account", "theme").agg(F.sum("value").alias("value"))
    return g.join(t, "account").select(
        "account", "theme", w.ratio("value", "total_value").alias("weight"), (w.ratio("value", "total_value") > THEME_CAP).alias("over")
    )


def fee_drag(values: DataFrame, fees: DataFrame) -> DataFrame:
    """Blended fund fee (percent) and its compounded cost over 10 and 30 years."""
    inv = values.groupBy("account").agg(F.sum("value").alias("invested"))
    paid = values.join(fees, "symbol").groupBy("account").agg(F.sum(F.col("value") * F.col("fee_pct")).alias("__f"))
    x = inv.where(F.col("invested") > 0).join(paid, "account", "left")
    fee = w.ratio(F.coalesce("__f", F.lit(0.0)), "invested")
    x = x.withColumn("blended_fee_pct", fee)

    def drag(years: int, pct: Column) -> Column:
        return F.col("invested") * (F.lit((1 + GROWTH) ** years) - F.pow(1 + GROWTH - pct / 100.0, F.lit(float(years))))

    return x.select(
        "account",
        "blended_fee_pct",
        (F.col("invested") * F.col("blended_fee_pct") / 100.0).alias("annual_cost"),
        drag(10, F.col("blended_fee_pct")).alias("drag_10y"),
        drag(30, F.col("blended_fee_pct")).alias("drag_30y"),
        drag(30, F.lit(1.0)).alias("one_pct_30y"),
    )


def portfolio_returns(values: DataFrame, bars: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Value-weighted daily returns per account.

    Names covering less than ``coverage`` of the account's dates are dropped and
    the rest renormalised; only dates on which all kept names trade count."""
    r = bars.select("symbol", "ts", w.ret("close", w.lag("close")).alias("r")).where(F.col("r").isNotNull())
    v = values.where(F.col("value") > 0).select("account", "symbol", "value")
    per_symbol = r.groupBy("symbol").agg(F.count("r").alias("__c"))
    # the dates of an account: its symbols' dates, deduplicated map-side first
    dates = v.join(bars.select("symbol", "ts"), "symbol").select("account", "ts").distinct().groupBy("account").agg(F.count(F.lit(1)).alias("__n"))
    kept = v.join(per_symbol, "symbol").join(dates, "account").where(F.col("__c") >= coverage * F.col("__n"))
    tot = kept.groupBy("account").agg(F.sum("value").alias("__t"), F.count(F.lit(1)).alias("__k"))
    wts = kept.join(tot, "account").select("account", "symbol", (F.col("value") / F.col("__t")).alias("__w"), "__k")
    g = wts.join(r, "symbol").groupBy("account", "ts").agg(
        F.sum(F.col("__w") * F.col("r")).alias("ret"), F.count(F.lit(1)).alias("__c"), F.max("__k").alias("__k")
    )
    return g.where(F.col("__c") == F.col("__k")).select("account", "ts", "ret")


def portfolio_vol(returns: DataFrame, bars: int = 252) -> DataFrame:
    """Weekly and annual volatility of the last ``bars`` returns."""
    newest = Window.partitionBy("account").orderBy(F.desc("ts"))
    x = returns.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= bars)
    sd = F.stddev_samp("ret")
    return x.groupBy("account").agg(
        (sd * math.sqrt(5)).alias("weekly_vol"), (sd * math.sqrt(252)).alias("annual_vol"), (1.96 * sd * math.sqrt(5)).alias("typical_week")
    )


def portfolio_drawdown(returns: DataFrame, min_returns: int = 60) -> DataFrame:
    """Worst drop of the compounded path, its peak and trough, and the first
    date the old peak was regained."""
    h = Window.partitionBy("account").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = returns.withColumn("eq", I.compounded(F.col("ret"), h))
    x = x.withColumns({"peak": F.max("eq").over(h), "n": F.count(F.lit(1)).over(Window.partitionBy("account"))})
    x = x.where(F.col("n") >= min_returns).withColumn("dd", F.col("eq") / F.col("peak") - 1.0)
    low = x.groupBy("account").agg(F.min(F.struct("dd", "ts", "peak")).alias("t"), F.max("n").alias("n"))
    j = x.join(low.select("account", "n", F.col("t.dd").alias("max_drawdown"), F.col("t.ts").alias("trough_ts"), F.col("t.peak").alias("__p")).withColumnRenamed("n", "__n"), "account")
    before = F.col("ts") <= F.col("trough_ts")
    g = j.groupBy("account").agg(
        F.max("max_drawdown").alias("max_drawdown"),
        F.max("__n").alias("n_returns"),
        F.max("trough_ts").alias("trough_ts"),
        F.max_by("ts", F.when(before, F.struct(F.col("eq"), -F.unix_micros("ts")))).alias("peak_ts"),
        F.min(F.when((F.col("ts") > F.col("trough_ts")) & (F.col("eq") >= F.col("__p")), F.col("ts"))).alias("recovered_ts"),
    )
    return g


def light_read(bars: DataFrame) -> DataFrame:
    """Trend flags, RSI, weekly plan and the action bucket of every symbol."""
    x = R.aged(I.rsi(bars))
    g = x.groupBy("symbol").agg(
        F.count("close").alias("bars"),
        R.at(0).alias("price"),
        R.tail(F.avg, 50).alias("sma50"),
        R.tail(F.avg, 200).alias("sma200"),
        F.max_by("rsi", F.when(F.col("rsi").isNotNull(), F.col("ts"))).alias("rsi"),
    )
    mature = F.col("bars") >= 400
    below = F.when(mature, F.col("price") < F.col("sma200"))
    al = R.alignment(R.multi_timeframe(bars)).select("symbol", "alignment")
    st = R.trend_stage(bars).select("symbol", "stage")
    pl = TP.trade_plan(bars).select("symbol", "target_ret", "stop_ret", "p_profit_intraperiod")
    trend = (
        F.when(F.col("alignment").isin("strong_up", "mostly_up"), "up")
        .when(F.col("alignment").isin("strong_down", "mostly_down"), "down")
        .otherwise("mixed")
    )
    j = g.join(al, "symbol", "left").join(st, "symbol", "left").join(pl, "symbol", "left").withColumn("trend", trend)
    bucket = (
        F.when(F.col("trend") == "down", "review")
        .when(F.col("rsi") >= 70, "trim")
        .when((F.col("trend") == "up") & (F.col("rsi") <= 45), "dip")
        .otherwise("hold")
    )
    return j.select(
        "symbol",
        "price",
        below.alias("below_200"),
        F.when(below, F.col("price") > F.col("sma50")).alias("recovering"),
        F.when(mature, F.col("stage")).alias("stage"),
        "trend",
        "rsi",
        "target_ret",
        "stop_ret",
        "p_profit_intraperiod",
        bucket.alias("bucket"),
    )


def atr_size(positions: DataFrame, atrs: DataFrame, risk_pct: float = 1.0, mult: float = 2.0) -> DataFrame:
    """Stop at entry - mult * ATR and the shares that keep the loss to
    ``risk_pct`` of the account; a flat price gets none.

    ``positions``: account, symbol, account_value, entry."""
    x = positions.join(atrs, "symbol", "left")
    ok = (F.col("atr") >= F.col("entry") * 1e-4) & (F.col("entry") > 0)
    risk = mult * F.col("atr")
    shares = w.ratio(F.col("account_value") * (risk_pct / 100), risk)
    x = x.withColumn("available", F.coalesce(ok, F.lit(False)))
    cols = {
        "stop_price": F.col("entry") - risk,
        "risk_per_share": risk,
        "dollar_risk": F.col("account_value") * (risk_pct / 100),
        "shares": shares,
        "position_share": w.ratio(shares * F.col("entry"), "account_value"),
    }
    return x.select("account", "symbol", "entry", "atr", "available", *[F.when(F.col("available"), c).alias(n) for n, c in cols.items()])


def kelly(win: Column, payoff: Column, fraction: float = 0.25) -> dict[str, Column]:
    """Full and fractional Kelly stakes from a win rate and a payoff ratio."""
    p = w.clip(win, 0.0, 1.0)
    b = F.greatest(F.lit(0.01), payoff)
    full = (b * p - (1 - p)) / b
    return {"full_kelly": full, "fractional_kelly": F.greatest(F.lit(0.0), full * fraction)}


def portfolio_heat(positions: DataFrame, cap: float = 0.06) -> DataFrame:
    """Money lost if every stop hit at once, as a share of the account.

    ``positions``: account, account_value, shares, entry, stop."""
    live = (F.col("stop") < F.col("entry")) & (F.col("stop") > 0)
    g = positions.groupBy("account").agg(
        F.coalesce(F.sum(F.when(live, F.col("shares") * (F.col("entry") - F.col("stop")))), F.lit(0.0)).alias("open_risk"),
        F.max("account_value").alias("__v"),
    )
    heat = w.ratio("open_risk", "__v")
    return g.select("account", "open_risk", heat.alias("heat"), w.flag(heat > cap).alias("hot"))


def health_check(values: DataFrame, stages: DataFrame) -> DataFrame:
    """Positions at the -8% stop or in a declining stage; big if at least 3% of
    the account's holdings."""
    own = values.where(F.col("value") != 0)
    tot = own.groupBy("account").agg(F.sum("value").alias("__t"))
    x = own.join(tot, "account").join(stages.select("symbol", "stage"), "symbol", "left")
    status = F.when(F.col("gain") <= -0.08, "stop").when(F.col("stage") == "stage4", "broken").otherwise("ok")
    return x.select("account", "symbol", status.alias("status"), (F.col("value") >= 0.03 * F.col("__t")).alias("big"))


def exit_alerts(values: DataFrame, reads: DataFrame, down: float = -0.12, up: float = 0.25) -> DataFrame:
    """One row per fired rule: below the 200 mean (risk or recovering), a large
    loss, a large gain."""
    x = values.where(F.col("value") != 0).join(reads.select("symbol", "below_200", "recovering"), "symbol", "left")
    cells = [
        F.when(w.flag(F.col("below_200")), F.when(w.flag(F.col("recovering")), "recovering").otherwise("risk")),
        F.when(w.flag(F.col("gain") <= down), F.lit("loss")),
        F.when(w.flag(F.col("gain") >= up), F.lit("gain")),
    ]
    return x.select("account", "symbol", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("kind"))
