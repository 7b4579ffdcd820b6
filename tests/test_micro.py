"""Constructed cases with analytic answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tapeline import schemas
from tapeline.functions import ranks, scan
from tapeline.operators import candles, chunks, composites, crosssection, indicators, ledger, levels, portfolio, regimes, tradeplan, trades
from tapeline.operators import volatility as V
from tapeline.sources import bars as B
from tapeline.sources import feeds, positions


def one(df, c):
    return df.orderBy("ts").select(c).collect()[-1][0]


@pytest.mark.parametrize("path,limit", [([100 + i for i in range(40)], 100.0), ([100 - i for i in range(40)], 0.0), ([50] * 40, 50.0)])
def test_rsi_limits(bars, path, limit):
    rows = indicators.rsi(bars(path)).orderBy("ts").select("rsi").collect()
    assert rows[-1][0] == limit
    assert all(r[0] is None for r in rows[:14])


def test_ewm_matches_recurrence(spark):
    random.seed(3)
    xs = [random.gauss(0, 1) for _ in range(1500)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "symbol string, ts long, x double")
    got = [r[0] for r in scan.ewm(df, {"y": ("x", 2 / 205), "z": ("x", 0.5)}).orderBy("ts").select("y").collect()]
    y = xs[0]
    for k, x in enumerate(xs):
        y = x if k == 0 else y + (x - y) * 2 / 205
        assert math.isclose(got[k], y, rel_tol=1e-9, abs_tol=1e-12)


def test_exact_quantiles_and_ranks(spark):
    random.seed(5)
    vals = [random.choice([1.0, 2.0, random.random() * 10]) for _ in range(5000)]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.25)).alias("a"), F.percentile("v", F.lit(0.9)).alias("b")).first()
    got = ranks.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}, buckets=16).first()
    assert math.isclose(got["a"], want["a"]) and math.isclose(got["b"], want["b"])
    r = {x["v"]: x["r"] for x in ranks.average_ranks(df, ["k"], "v", "r", buckets=16).collect()}
    ordered = sorted(vals)
    for v in (1.0, 2.0, max(vals), min(vals)):
        where = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert r[v] == sum(where) / len(where)


def test_quantiles_of_one_hot_value(spark):
    df = spark.range(1000).select(F.lit("g").alias("k"), F.lit(7.0).alias("v"))
    assert ranks.exact_quantiles(df, ["k"], "v", {"m": 0.5}).first()["m"] == 7.0


def test_bullish_engulfing_and_doji(bars):
    o = [100] * 10 + [100, 97]
    c = [100.5] * 10 + [98, 101]
    df = bars(c, [max(a, b) + 1 for a, b in zip(o, c)], [min(a, b) - 1 for a, b in zip(o, c)], o)
    names = {r["name"] for r in candles.events(df, 1).collect()}
    assert "Bullish Engulfing" in names
    o2, c2 = [100] * 11, [101] * 10 + [100.02]
    df = bars(c2, [103] * 11, [98] * 10 + [98.5], o2)
    doji = [r for r in candles.events(df, 1).collect() if r["name"] == "Doji"]
    assert doji and doji[0]["bias"] == "neutral"


def test_trend_template(bars):
    up = regimes.trend_template(bars([50 + i / 3 for i in range(300)])).first()
    assert up["score"] == 8 and up["passes"] and up["stage"] == 2
    down = regimes.trend_template(bars([150 - i / 3 for i in range(300)])).first()
    assert down["stage"] == 4 and not down["passes"]
    assert not regimes.trend_template(bars([100] * 100)).first()["available"]


def test_multi_timeframe(bars):
    rows = regimes.multi_timeframe(bars([50 + i for i in range(300)])).collect()
    assert len(rows) == 5 and all(r["direction"] == "uptrend" for r in rows)
    assert regimes.multi_timeframe(bars([50 + i for i in range(30)])).count() == 2
    r = regimes.ma_regime(bars([50 + i for i in range(300)])).first()
    assert r["cross"] == "golden" and r["above_sma200"]
    assert regimes.ma_regime(bars([50 + i for i in range(30)])).first()["sma200"] is None


def test_trend_stage(bars):
    assert regimes.trend_stage(bars([50 + i for i in range(300)])).first()["stage"] == "stage2"
    assert regimes.trend_stage(bars([400 - i for i in range(300)])).first()["stage"] == "stage4"
    fall = [400 - i for i in range(300)] + [101 + 4 * i for i in range(20)]
    assert regimes.trend_stage(bars(fall)).first()["stage"] == "recovering"


def test_level_excludes_today(bars):
    highs = [101] * 80
    highs[50] = 120
    r = levels.resistance_state(bars([100] * 80, highs)).first()
    assert r["level"] == 120 and r["state"] == "below"


def test_fresh_breakout_and_approach(bars):
    highs = [101.0] * 80
    for k in (40, 52, 64):
        highs[k] = 110.0
    r = levels.resistance_state(bars([100] * 79 + [111.5], highs[:79] + [112.0])).first()
    assert r["state"] == "fresh_breakout" and r["touches"] >= 2
    highs = [101.0] * 80
    highs[50] = 110.0
    r = levels.resistance_state(bars([100] * 79 + [108.5], highs)).first()
    assert r["state"] == "approaching"


def test_crossover(bars):
    up = regimes.crossover_system(bars([50 + i / 4 for i in range(400)])).first()
    assert up["state"] == "buy" and up["conditions_met"] == 3
    assert regimes.crossover_system(bars([150 - i / 4 for i in range(400)])).first()["state"] == "sell"


def test_gap_up_that_fades(bars):
    n = 300
    o, c, h, l = [100.0] * n, [100.0] * n, [100.5] * n, [99.5] * n
    for k in range(20, 300, 7):
        o[k], h[k], l[k], c[k] = 101.0, 101.2, 99.8, 100.0
    rows = {(r["direction"], r["bucket"]): r for r in regimes.gap_stats(bars(c, h, l, o)).collect()}
    r = rows[("up", "small")]
    assert r["n"] >= 10 and r["faded_rate"] >= 0.5


def test_gap_needs_open(bars):
    with pytest.raises(Exception):
        regimes.gap_stats(bars([1, 2, 3]).drop("open")).collect()


def test_extension(bars):
    assert regimes.extension_state(bars([100] * 200 + [100 + 4 * i for i in range(1, 9)])).first()["state"] in ("extended", "blowoff")
    assert regimes.extension_state(bars([100 + math.sin(i) for i in range(200)])).first()["state"] == "normal"


def test_relative_strength(bars):
    n = 150
    s = bars([100 * (1 + 0.6 * i / n) for i in range(n)])
    b = bars([100 * (1 + 0.2 * i / n) for i in range(n)]).select("ts", "close")
    r = regimes.relative_strength(s, b).first()
    assert r["excess"] > 0 and r["outperforming"]
    assert regimes.relative_strength(bars([100] * 50), b).count() == 0


def test_trade_plan_order_and_width(bars):
    random.seed(1)

    def path(sd):
        p = [100.0]
        for _ in range(399):
            p.append(p[-1] * math.exp(random.gauss(0, sd)))
        return p

    calm, wild = path(0.004), path(0.03)
    plans = {}
    for name, p in (("calm", calm), ("wild", wild)):
        hi = [x * (1 + 0.5 * (0.004 if name == "calm" else 0.03)) for x in p]
        lo = [x * (1 - 0.5 * (0.004 if name == "calm" else 0.03)) for x in p]
        r = tradeplan.trade_plan(bars(p, hi, lo)).first()
        assert r["target"] > r["entry"] > r["stop"] and r["stretch"] >= r["target"]
        plans[name] = r
    assert plans["wild"]["target_ret"] > plans["calm"]["target_ret"]
    vols = {}
    for name, p in (("calm", calm), ("wild", wild)):
        vols[name] = {r["estimator"]: r["value"] for r in V.latest(bars(p)).collect()}
    assert vols["calm"]["ewma"] < vols["wild"]["ewma"] and vols["calm"]["close_to_close"] < vols["wild"]["close_to_close"]


def test_position_walk_toggles(spark):
    import datetime as dt

    entry = [1, 0, 1, 1, 0, 0, 1, 1, 0]
    exit_ = [0, 0, 1, 1, 0, 1, 0, 1, 0]
    df = spark.createDataFrame(
        [("A", dt.datetime(2020, 1, 1 + k), bool(e), bool(x)) for k, (e, x) in enumerate(zip(entry, exit_))], "symbol string, ts timestamp, e boolean, x boolean"
    )
    got = [r[0] for r in trades.position_walk(df, F.col("e"), F.col("x")).orderBy("ts").select("pos").collect()]
    want, pos = [0], 0
    for e, x in list(zip(entry, exit_))[:-1]:
        pos = 1 if pos == 0 and e else 0 if pos == 1 and x else pos
        want.append(pos)
    assert got == want


def test_no_lookahead(bars):
    random.seed(9)
    p = [100.0]
    for _ in range(299):
        p.append(p[-1] * math.exp(random.gauss(0, 0.02)))
    full = V.with_blend(indicators.compute_all(bars(p))).orderBy("ts").collect()
    cut = V.with_blend(indicators.compute_all(bars(p[:220]))).orderBy("ts").collect()
    for a, b in zip(full, cut):
        for c in ("sma50", "ema26", "rsi", "macd_signal", "bb_upper", "sigma"):
            assert (a[c] is None and b[c] is None) or math.isclose(a[c], b[c], rel_tol=1e-9)


def test_chunk_path_equals_plain(bars):
    random.seed(2)
    df = bars([100 + random.random() for _ in range(700)])
    plain = [r[0] for r in df.withColumn("m", indicators.sma("close", 50)).orderBy("ts").select("m").collect()]
    got = [r[0] for r in chunks.rolling(df, {"m": ("avg", "close", 50)}, 64).orderBy("ts").select("m").collect()]
    assert len(plain) == len(got) and all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(plain, got))


def test_sector_selloff(spark):
    import datetime as dt

    rows = []
    for s in ["A", "B", "C", "D", "E"]:
        for k in range(30):
            c = 100.0 if k < 29 else (100.5 if s == "A" else 98.0)
            rows.append((s, "chips", dt.datetime(2020, 1, 1) + dt.timedelta(days=k), c))
    df = spark.createDataFrame(rows, "symbol string, sector string, ts timestamp, close double")
    last = {r["symbol"]: r for r in crosssection.sector_pulse(df).collect() if r["ts"] == dt.datetime(2020, 1, 30)}
    assert last["A"]["event"] == "broad_selloff" and last["A"]["survivor"] and not last["B"]["survivor"]
    assert crosssection.sector_pulse(df.where("symbol < 'C'")).count() == 0


def test_look_through(spark):
    v = spark.createDataFrame([("a", "ETFX", 1000.0, True), ("a", "GOOGL", 500.0, False)], "account string, symbol string, value double, is_fund boolean")
    f = spark.createDataFrame([("ETFX", "AAPL", 0.5), ("ETFX", "GOOG", 0.2)], schemas.FUND_HOLDINGS)
    got = {r["underlying"]: r for r in portfolio.look_through(v, f, {"GOOG": "GOOGL"}).collect()}
    assert got["AAPL"]["value"] == 500 and got["GOOGL"]["value"] == 700 and got["GOOGL"]["stacked"]
    assert math.isclose(portfolio.residuals(v, f).first()["residual"], 300.0)


def test_concentration(spark):
    e = spark.createDataFrame([("a", "X", 600.0), ("a", "Y", 300.0), ("a", "Z", 100.0)], "account string, underlying string, value double")
    v = e.select("account", F.col("underlying").alias("symbol"), "value", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("string").alias("error"))
    acc = spark.createDataFrame([("a", 100000.0)], schemas.ACCOUNTS)
    none = spark.createDataFrame([], "account string, residual double")
    r = portfolio.concentration(e, none, acc, v).first()
    assert math.isclose(r["hhi"], 0.46) and math.isclose(r["effective_n"], 1 / 0.46)


def test_failed_price(spark):
    h = spark.createDataFrame([("a", "AAA", 1.0, 2.0), ("a", "NOPE", 1.0, None)], schemas.HOLDINGS)
    p = spark.createDataFrame([("AAA", 3.0)], "symbol string, price double")
    f = spark.createDataFrame([], schemas.FUND_HOLDINGS)
    got = {r["symbol"]: r for r in portfolio.value_holdings(h, p, f).collect()}
    assert got["NOPE"]["error"] == "no data" and got["NOPE"]["value"] is None and got["AAA"]["value"] == 3.0


def test_sizing_kelly_heat(spark):
    pos = spark.createDataFrame([("a", "X", 5000.0, 100.0)], "account string, symbol string, account_value double, entry double")
    atr = spark.createDataFrame([("X", 2.0)], "symbol string, atr double")
    r = portfolio.atr_size(pos, atr).first()
    assert r["dollar_risk"] == 50 and r["shares"] == 12.5 and r["stop_price"] == 96
    k = spark.range(1).select(*[c.alias(n) for n, c in portfolio.kelly(F.lit(0.6), F.lit(2.0)).items()]).first()
    assert math.isclose(k["full_kelly"], 0.4) and math.isclose(k["fractional_kelly"], 0.1)
    k = spark.range(1).select(*[c.alias(n) for n, c in portfolio.kelly(F.lit(0.3), F.lit(1.0)).items()]).first()
    assert k["full_kelly"] < 0 and k["fractional_kelly"] == 0
    hp = spark.createDataFrame([("a", 1000.0, 10.0, 100.0, 98.0), ("a", 1000.0, 10.0, 50.0, 48.0)], "account string, account_value double, shares double, entry double, stop double")
    assert math.isclose(portfolio.portfolio_heat(hp).first()["heat"], 0.04)


def test_ledger_dedupe_and_scoring(spark, bars):
    import datetime as dt

    day = dt.datetime(2020, 1, 10)
    new = spark.createDataFrame([(day, "X", "dip_buy", "up", None, 1.0, None)] * 2, schemas.LEDGER)
    one_row = ledger.log_signals(new)
    assert one_row.count() == 1 and ledger.log_signals(new, one_row).count() == 0
    s = ledger.score_forward(one_row, bars([100 + k for k in range(60)]), bars([100] * 60).select("ts", "close")).first()
    assert s["ret_21"] > 0 and s["bench_21"] == 0 and s["ret_63"] is None


def test_insider_summary(spark):
    from tapeline.operators import insiders

    tx = spark.createDataFrame(
        [("ACME", "P", 5000.0, 184.0, "A", "a", "CEO"), ("ACME", "P", 2000.0, 186.0, "A", "b", "Director"), ("ACME", "P", 1000.0, 185.0, "A", "c", None), ("ACME", "M", 9.0, 0.0, "A", "d", None)],
        "issuer string, code string, shares double, price double, ad string, owner string, role string",
    )
    r = insiders.summary(tx).first()
    assert r["signal"] == "buying" and r["cluster_buy"] and r["buy_shares"] == 8000 and math.isclose(r["buy_avg_price"], 185.0) and r["buy_csuite"]


def test_positions_csv(spark):
    text = 'My account\n"Symbol","Description","Quantity","Cost Basis"\n"BRK-B","x",10,"$1,500.00"\nAAPL,,"2",100\nAAPL,,"2",300\nCash,,,"5"\nTotal,,0,1\n'
    lines = positions.numbered_lines(spark.createDataFrame([("a", text)], "account string, text string"))
    got = {r["symbol"]: (r["shares"], r["avg_cost"]) for r in positions.positions_from_lines(lines).collect()}
    assert got == {"BRK-B": (10.0, 150.0), "AAPL": (4.0, 100.0)}


def test_validate_holdings(spark):
    raw = spark.createDataFrame(
        [("a", "X", "10", None), ("a", "Y", "NaN", None), ("a", "Z", "-5", None), ("a", "W", "1", "Infinity"), ("a", "", "1", None)], "account string, symbol string, shares string, avg_cost string"
    )
    got = {r["symbol"]: r for r in positions.validate_holdings(raw).collect()}
    assert got["X"]["shares"] == 10.0 and got["X"]["error"] is None
    assert "non-finite" in got["Y"]["error"] and "negative" in got["Z"]["error"] and "non-finite" in got["W"]["error"] and got[""]["error"]


def test_future_dates_skip_weekends(spark, bars):
    from tapeline.operators import forecast

    df = bars([1, 2, 3, 4, 5])  # ends on Sunday 2020-01-05
    rows = [r["ts"] for r in forecast.future_dates(df, 6).orderBy("step").collect()]
    assert rows[0].weekday() == 0 and all(r.weekday() < 5 for r in rows) and rows == sorted(rows)


def test_norm_sector_and_buckets(spark):
    df = spark.createDataFrame([("technology",), ("odd thing",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(feeds.norm_sector(F.col("s"))).collect()] == ["Technology", "Odd Thing", "Other", "Other"]
    b = spark.createDataFrame([(-0.1,), (0.01,), (0.05,), (0.2,), (0.5,), (50.0,)], "d double").select(levels.ath_bucket(F.col("d"))["p_reach"]).collect()
    assert [r[0] for r in b] == [0.95, 0.88, 0.62, 0.33, 0.08, 0.08]


def test_conviction(spark):
    rs = spark.createDataFrame([("X", True), ("Y", False)], "symbol string, outperforming boolean")
    tt = spark.createDataFrame([("X", True, True, 2), ("Y", True, False, 4)], "symbol string, available boolean, passes boolean, stage long")
    ins = spark.createDataFrame([("X", "buying", True)], "issuer string, signal string, cluster_buy boolean")
    run = spark.createDataFrame([("Y", True)], "symbol string, hot_runup boolean")
    cr = spark.createDataFrame([("X", "buy"), ("W", "buy")], "symbol string, state string")
    got = {r["symbol"]: r for r in composites.conviction(rs, tt, ins, run, cr).collect()}
    assert got["X"]["verdict"] == "high_bull" and got["X"]["direction"] == "up"
    assert got["Y"]["verdict"] == "bear" and got["Y"]["caution"]
    assert got["W"]["verdict"] == "none" and got["W"]["net"] == 0


def test_clean_bars_and_candles(spark, bars):
    df = bars([1.0, float("nan"), 3.0]).withColumn("symbol", F.lit(" x ")).withColumn("volume", F.lit(None).cast("double"))
    out = B.clean_bars(df)
    assert out.count() == 2 and out.first()["symbol"] == "X"
    assert B.to_candles(out).first()["volume"] == 0


def test_schema_contract(bars):
    with pytest.raises(schemas.SchemaError):
        schemas.require(bars([1]).drop("close"), schemas.BARS)
    with pytest.raises(schemas.SchemaError):
        B.bars_from_trades(bars([1]))
