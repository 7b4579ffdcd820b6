"""Composite verdicts: one row per symbol built from the single reads.

Every input is already one small row set per symbol, so composition is a chain
of joins on ``symbol`` and array expressions over nullable columns; nothing is
gathered per symbol again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..session import keep
from . import candles as C
from . import crosssection as X
from . import evaluations as E
from . import indicators as I
from . import patterns as PT
from . import regimes as R
from . import tradeplan as TP
from . import trades as TR
from . import volume as VOL

# fixed values: evidence weights and component weights
STRENGTH = {"strong": 2, "moderate": 1, "weak": 0}
POSTURE_WEIGHTS = {
    "trend": 1.5,
    "multi_timeframe": 2.0,
    "regime": 2.0,
    "rsi": 1.0,
    "macd": 1.0,
    "template": 2.0,
    "candles": 1.5,
    "volume": 1.0,
    "patterns": 1.0,
    "relative_strength": 1.5,
}
RECENT_BARS = 10
MIN_N = 10


def earnings_runup(bars: DataFrame, next_events: DataFrame, lookback: int = 10, big: float = 0.08, days: int = 7) -> DataFrame:
    """Run-up into an event within a week."""
    g = R.aged(bars).groupBy("symbol").agg(
        F.when(F.count("close") > lookback + 1, w.ratio(R.at(0), R.at(lookback)) - 1.0).alias("runup")
    )
    soon = F.col("days_to_event") <= days
    return next_events.join(g, "symbol").select(
        "symbol", "next_event", "days_to_event", "runup", soon.alias("soon"), w.flag(soon & (F.col("runup") >= big)).alias("hot_runup")
    )


# fixed values: rating keys and labels
RATINGS = {"strong_buy": "Strong Buy", "buy": "Buy", "hold": "Hold", "underperform": "Underperform", "sell": "Sell"}


def consensus_snapshot(bars: DataFrame, info: DataFrame) -> DataFrame:
    """Upside to the mean target, rating label, and whether a buy consensus
    stands through a drawdown over 12%."""
    g = R.aged(bars).groupBy("symbol").agg(
        R.at(0).alias("price"),
        F.when(F.count("close") > 63, w.ratio(R.at(0), F.max(R.within(0, 62))) - 1.0).alias("drawdown"),
    )
    x = info.join(g, "symbol").where((F.col("target_mean") > 0) & (F.col("n_analysts") > 0) & (F.col("price") > 0))
    key = F.lower("rating_key")
    labels = F.create_map(*[F.lit(v) for kv in RATINGS.items() for v in kv])
    up = F.col("target_mean") / F.col("price") - 1.0
    return x.select(
        "symbol",
        "price",
        "target_mean",
        "n_analysts",
        F.coalesce(F.try_element_at(labels, key), F.initcap(key), F.lit("n/a")).alias("rating"),
        up.alias("upside"),
        w.flag((F.col("drawdown") < -0.12) & (up > 0.10) & key.isin("buy", "strong_buy")).alias("calm"),
    )


def _present(*cells: Column) -> Column:
    return F.filter(F.array(*cells), lambda s: s.isNotNull())


def conviction(rs: DataFrame, template: DataFrame, insiders: DataFrame, runup: DataFrame, crossover: DataFrame) -> DataFrame:
    """Independent components, their weights and the verdict.

    Chart crossovers are listed with weight 0; a hot run-up is a caution."""
    x = (
        template.select("symbol", "available", "passes", "stage")
        .join(rs.select("symbol", "outperforming"), "symbol", "full")
        .join(insiders.select(F.col("issuer").alias("symbol"), "signal", "cluster_buy"), "symbol", "full")
        .join(runup.select("symbol", "hot_runup"), "symbol", "full")
        .join(crossover.select("symbol", F.col("state").alias("cross_state")), "symbol", "full")
    )

    def comp(name: str, strength: str, state: str, cond: Column) -> Column:
        return F.when(
            w.flag(cond),
            F.struct(
                F.lit(name).alias("name"), F.lit(strength).alias("strength"), F.lit(state).alias("state"), F.lit(STRENGTH[strength]).cast("long").alias("weight")
            ),
        )

    ready = w.flag(F.col("available"))
    buying = w.flag(F.col("cluster_buy")) | (F.col("signal") == "buying")
    comps = _present(
        comp("momentum", "strong", "bullish", F.col("outperforming")),
        comp("momentum", "strong", "bearish", ~F.col("outperforming")),
        comp("trend_stage", "moderate", "bullish", ready & F.col("passes")),
        comp("trend_stage", "moderate", "bearish", ready & ~F.col("passes") & (F.col("stage") != 2)),
        comp("insider_buying", "strong", "bullish", buying),
        comp("insider_activity", "weak", "neutral", ~w.flag(buying) & (F.col("signal") == "selling")),
        comp("earnings_runup", "moderate", "caution", F.col("hot_runup")),
        comp("crossover", "weak", "bullish", F.col("cross_state") == "buy"),
        comp("crossover", "weak", "bearish", F.col("cross_state") == "sell"),
    )

    def total(state: str) -> Column:
        return F.aggregate("components", F.lit(0).cast("long"), lambda a, c: a + F.when(c["state"] == state, c["weight"]).otherwise(F.lit(0).cast("long")))

    x = x.withColumn("components", comps).withColumns({"bull": total("bullish"), "bear": total("bearish"), "caution": total("caution")})
    count = lambda f: F.size(F.filter("components", f)).cast("long")
    x = x.withColumns(
        {
            "aligned": count(lambda c: (c["state"] == "bullish") & (c["strength"] != "weak")),
            "strong_bull": count(lambda c: (c["state"] == "bullish") & (c["strength"] == "strong")),
            "net": F.col("bull") - F.col("bear") - F.col("caution"),
        }
    )
    high = (F.col("aligned") >= 2) & (F.col("strong_bull") >= 1) & (F.col("bear") == 0)
    verdict = (
        F.when(high, "high_bull").when(F.col("net") <= -2, "bear").when((F.col("bull") == 0) & (F.col("bear") == 0), "none").otherwise("mixed")
    )
    return x.select(
        "symbol",
        (F.size("components") > 0).alias("available"),
        verdict.alias("verdict"),
        F.when(high, "up").when(F.col("net") <= -2, "down").alias("direction"),
        "aligned",
        "net",
        F.size("components").cast("long").alias("n_components"),
        (F.col("caution") > 0).alias("caution"),
        "components",
    )


def latest_indicators(bars: DataFrame) -> DataFrame:
    return I.latest_snapshot(I.compute_all(bars), ["close", "sma50", "rsi", "macd", "macd_signal"])


def _edge_candles(bars: DataFrame) -> DataFrame:
    """Mean of the three newest candles, each scaled by its own 10-bar edge."""
    top = C.detect(bars).where(F.col("pos") <= 3)
    edge = E.candle_backtest(bars).where(F.col("horizon") == 10).select("symbol", "name", "bias", "edge")
    x = top.join(edge, ["symbol", "name", "bias"], "left")
    b = F.when(F.col("bias") == "bullish", 1.0).when(F.col("bias") == "bearish", -1.0).otherwise(0.0)
    rec = 1.0 - (F.col("pos") - 1) * 0.3
    size = 0.4 + F.greatest(F.lit(0.0), F.coalesce("edge", F.lit(0.0))) * 2.0
    return x.groupBy("symbol").agg((F.sum(b * size * rec) / F.sum(rec)).alias("candles"))


def _volume_vote(bars: DataFrame) -> DataFrame:
    top = VOL.detect(bars).where(F.col("pos") <= 3)
    v = (
        F.when(F.col("name") == "Breakout on Volume", 0.6)
        .when(F.col("name") == "Breakdown on Volume", -0.6)
        .when((F.col("name") == "Volume Spike") & (F.col("bias") == "bullish"), 0.2)
        .when(F.col("name") == "Volume Spike", -0.2)
        .otherwise(0.0)
    )
    votes = top.groupBy("symbol").agg(F.sum(v).alias("__v"))
    return VOL.analysis(bars).where("available").select("symbol").join(votes, "symbol", "left").select(
        "symbol", F.coalesce("__v", F.lit(0.0)).alias("volume")
    )


def posture_inputs(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Ten component values in [-1, 1] per symbol; an absent component is NULL."""
    chart = PT.chart_tail(bars)
    tr = I.lin_trend(chart)
    sign = F.when(F.col("direction") == "uptrend", 1.0).when(F.col("direction") == "downtrend", -1.0).otherwise(0.0)
    tr = tr.select("symbol", (sign * (0.5 + 0.5 * w.clip(F.col("r2"), 0.0, 1.0))).alias("trend"))
    al = R.alignment(R.multi_timeframe(bars)).select("symbol", ((F.col("ups") - F.col("downs")) / F.col("horizons")).alias("multi_timeframe"))
    half = lambda c: F.when(c, 0.5).otherwise(-0.5)
    rg = R.ma_regime(bars).select(
        "symbol", F.when(F.col("cross").isNotNull(), half(F.col("above_sma200")) + half(F.col("cross") == "golden")).alias("regime")
    )
    li = latest_indicators(bars)
    rsi = F.col("rsi")
    li = li.select(
        "symbol",
        F.when(rsi >= 70, -0.6).when(rsi <= 30, 0.6).otherwise((rsi - 50) / 40 * 0.4).alias("rsi"),
        F.when(F.col("macd") > F.col("macd_signal"), 0.6).when(F.col("macd_signal").isNotNull(), -0.6).alias("macd"),
    )
    rs = keep(R.relative_strength(bars, benchmark))
    tt = R.trend_template(bars, rs)
    base = (F.col("score") - 4) / 4.0
    tv = F.when(F.col("stage") == 4, F.least(base, F.lit(-0.5))).when(F.col("stage") == 2, F.greatest(base, F.lit(0.5))).otherwise(base)
    tt = tt.select("symbol", F.when(F.col("available"), tv).alias("template"))
    pt = PT.chart_patterns(bars).where(F.col("pos") <= 3)
    bias = F.when(F.col("bias") == "bullish", 1.0).when(F.col("bias") == "bearish", -1.0).otherwise(0.0)
    pt = pt.groupBy("symbol").agg((F.sum(bias) / 3.0).alias("patterns"))
    rv = rs.select("symbol", F.col("value").alias("relative_strength"))
    out = tr
    for other in (al, rg, li, tt, _edge_candles(bars), _volume_vote(bars), pt, rv):
        out = out.join(keep(other), "symbol", "left")
    return out


def posture_score(inputs: DataFrame) -> DataFrame:
    """Weighted mean and dispersion of the components, score, interval,
    confidence and posture."""
    comps = _present(
        *[
            F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("name"), w.clip(F.col(n), -1.0, 1.0).alias("v"), F.lit(wt).alias("w")))
            for n, wt in POSTURE_WEIGHTS.items()
        ]
    )
    x = inputs.withColumn("__c", comps).where(F.size("__c") > 0)
    zero = F.lit(0.0)
    x = x.withColumn("__w", F.aggregate("__c", zero, lambda a, c: a + c["w"]))
    x = x.withColumn("__m", F.aggregate("__c", zero, lambda a, c: a + c["v"] * c["w"]) / F.col("__w"))
    m = F.col("__m")
    x = x.withColumn("__s", F.sqrt(F.aggregate("__c", zero, lambda a, c: a + c["w"] * (c["v"] - m) * (c["v"] - m)) / F.col("__w")))
    s = F.col("__m") * 100.0
    margin = F.least(F.col("__s") * 100.0, F.lit(100.0))
    posture = (
        F.when(s >= 50, "strongly_bullish").when(s >= 20, "bullish").when(s <= -50, "strongly_bearish").when(s <= -20, "bearish").otherwise("neutral")
    )
    return x.select(
        *[c for c in inputs.columns if c not in POSTURE_WEIGHTS],
        s.alias("score"),
        F.greatest(F.lit(-100.0), s - margin).alias("low"),
        F.least(F.lit(100.0), s + margin).alias("high"),
        w.clip((1.0 - F.col("__s")) * 100.0, 0.0, 100.0).alias("confidence"),
        posture.alias("posture"),
        F.when(s >= 20, "BUY").when(s <= -20, "SELL").otherwise("HOLD").alias("verdict"),
        F.size("__c").cast("long").alias("n_components"),
    )


def situation_inputs(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The facts the bias votes and the situation rules read."""
    li = latest_indicators(bars)
    rg = R.ma_regime(bars).select("symbol", "above_sma200", "cross")
    al = R.alignment(R.multi_timeframe(bars)).select("symbol", "alignment")
    tt = R.trend_template(bars, R.relative_strength(bars, benchmark)).select("symbol", "stage", "passes")
    cd = C.detect(bars).where(F.col("pos") == 1).select("symbol", F.col("name").alias("candle"), F.col("bias").alias("candle_bias"))
    vs = VOL.detect(bars).groupBy("symbol").agg(
        *[F.max((F.col("name") == n).cast("int")).alias(a) for n, a in (("Breakout on Volume", "v_break"), ("Breakdown on Volume", "v_down"), ("Volume Dry-Up", "v_dry"))]
    )
    sr = PT.support_resistance(bars).where(F.col("pos") == 1)
    sr = sr.groupBy("symbol").agg(
        F.max(F.when(F.col("kind") == "resistance", F.col("level"))).alias("near_resistance"),
        F.max(F.when(F.col("kind") == "support", F.col("level"))).alias("near_support"),
    )
    out = li
    for other in (rg, al, tt, cd, vs, sr):
        out = out.join(keep(other), "symbol", "left")
    return out


def directional_bias(facts: DataFrame) -> DataFrame:
    """Bull and bear votes, the bias and whether a level lies within 3%."""
    vote = lambda c, n=1: F.when(w.flag(c), n).otherwise(0)
    known = F.col("macd_signal").isNotNull()
    up = F.col("macd") > F.col("macd_signal")
    bull = (
        vote(F.col("above_sma200"))
        + vote(F.col("cross") == "golden")
        + vote(F.col("alignment").isin("strong_up", "mostly_up"))
        + vote(known & up)
        + vote(F.col("stage") == 2, 2)
        + vote(F.col("candle_bias") == "bullish")
    )
    bear = (
        vote(~F.col("above_sma200"))
        + vote(F.col("cross") == "death")
        + vote(F.col("alignment").isin("strong_down", "mostly_down"))
        + vote(known & ~up)
        + vote(F.col("stage") == 4, 2)
        + vote(F.col("candle_bias") == "bearish")
    )
    x = facts.withColumns({"bull": bull.cast("long"), "bear": bear.cast("long")})
    return x.withColumns(
        {
            "bias": F.when(F.col("bull") > F.col("bear"), "bullish").when(F.col("bear") > F.col("bull"), "bearish").otherwise("neutral"),
            "at_resistance": w.flag(F.col("near_resistance") / F.col("close") - 1.0 <= 0.03),
            "at_support": w.flag(F.col("near_support") / F.col("close") - 1.0 >= -0.03),
        }
    )


def situation_rules(facts: DataFrame, keep: int = 6) -> DataFrame:
    """Rule hits in priority order, the first ``keep`` per symbol."""
    x = directional_bias(facts)
    bull, bear = F.col("bias") == "bullish", F.col("bias") == "bearish"
    hot, cold = F.col("rsi") > 70, F.col("rsi") < 30
    green, red = F.col("candle_bias") == "bullish", F.col("candle_bias") == "bearish"
    up = F.col("macd") > F.col("macd_signal")
    # fixed values: rule codes, their bias and priority, in order
    rules = [
        ("stage2_uptrend", F.lit("bullish"), 1, F.col("passes")),
        ("continuation_at_support", F.lit("bullish"), 1, bull & ~w.flag(hot) & F.col("at_support") & green),
        ("coil_below_resistance", F.lit("bullish"), 1, bull & F.col("at_resistance") & (F.col("v_dry") == 1)),
        ("breakout_confirmed", F.lit("bullish"), 1, F.col("v_break") == 1),
        ("extended", F.lit("neutral"), 2, bull & hot),
        ("caution_at_resistance", F.lit("bearish"), 2, bull & F.col("at_resistance") & red),
        ("downtrend_regime", F.lit("bearish"), 1, bear & ((F.col("cross") == "death") | w.flag(~F.col("above_sma200")))),
        ("oversold_bounce", F.lit("neutral"), 2, bear & cold & green),
        ("breakdown_confirmed", F.lit("bearish"), 1, F.col("v_down") == 1),
        ("choppy_range", F.lit("neutral"), 2, F.col("alignment") == "mixed"),
        ("macd_momentum", F.when(up, "bullish").otherwise("bearish"), 3, F.col("macd_signal").isNotNull()),
    ]
    cells = [
        F.when(
            w.flag(c), F.struct(F.lit(p).cast("long").alias("priority"), F.lit(i).alias("ord"), F.lit(code).alias("rule"), b.alias("rule_bias"))
        )
        for i, (code, b, p, c) in enumerate(rules)
    ]
    hits = F.slice(F.array_sort(_present(*cells)), 1, keep)
    return x.select("symbol", "bias", F.posexplode(hits).alias("pos", "h")).select(
        "symbol", "bias", (F.col("pos") + 1).cast("long").alias("pos"), "h.rule", "h.rule_bias", "h.priority"
    )


def buy_checklist(resistance: DataFrame, dip: DataFrame, sector: DataFrame, ext: DataFrame, runup: DataFrame, pros: DataFrame, gap: DataFrame) -> DataFrame:
    """(symbol, factor, status): each engine's read as good, warn, bad or info."""
    x = resistance.select("symbol", "uptrend")
    for df, cols in (
        (dip, [F.lit(True).alias("has_dip"), F.col("active").alias("dip_active")]),
        (sector, [F.col("event")]),
        (ext, [F.col("state").alias("ext_state")]),
        (runup, [F.col("soon"), F.col("hot_runup")]),
        (pros, [F.lit(True).alias("has_pros")]),
        (gap, [F.col("gapped_today")]),
    ):
        x = x.join(keep(df.select("symbol", *cols)), "symbol", "left")

    def factor(name: str, cond: Column, status: Column) -> Column:
        return F.when(w.flag(cond), F.struct(F.lit(name).alias("factor"), status.alias("status")))

    cells = _present(
        factor("long_term_trend", F.col("uptrend").isNotNull(), F.when(F.col("uptrend"), "good").otherwise("bad")),
        factor("dip_signal", F.col("has_dip"), F.when(F.col("dip_active"), "good").otherwise("info")),
        factor("sector_context", F.col("event").isNotNull(), F.when(F.col("event") == "broad_selloff", "warn").otherwise("info")),
        factor(
            "stretch",
            F.col("ext_state") != "normal",
            F.when(F.col("ext_state").isin("extended", "blowoff", "stretched_below"), "warn").otherwise("good"),
        ),
        factor("earnings_risk", F.col("soon"), F.when(w.flag(F.col("hot_runup")), "bad").otherwise("warn")),
        factor("street_consensus", F.col("has_pros"), F.lit("info")),
        factor("opening_gap", F.col("gapped_today"), F.lit("info")),
    )
    return x.select("symbol", F.inline(cells))


def _read(bars: DataFrame, stats: DataFrame) -> DataFrame:
    """Recent candle events with their own 10-bar statistics and weights."""
    ev = C.newest(C.events(bars, RECENT_BARS + 5), C.MAX_SIGNALS).where(F.col("bars_ago") <= RECENT_BARS)
    s = stats.where((F.col("horizon") == 10) & (F.col("samples") >= MIN_N)).select(
        "symbol", "name", "bias", "samples", "win_rate", "edge", "base_up"
    )
    x = ev.join(s, ["symbol", "name", "bias"])
    p = F.when(F.col("bias") == "bearish", 1.0 - F.col("win_rate")).otherwise(F.col("win_rate"))
    wt = F.sqrt(F.least("samples", F.lit(40)).cast("double")) * F.pow(F.lit(0.9), F.col("bars_ago").cast("double"))
    return x.withColumns({"p_up": p, "w": wt})


def _tilt(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_signals"),
        (F.sum(F.col("p_up") * F.col("w")) / F.sum("w")).alias("p_up"),
        F.max("base_up").alias("base_up"),
        (F.sum(F.when(F.col("p_up") >= F.col("base_up"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("bull_w"),
    )


def pattern_read(bars: DataFrame, window: int = 504, min_bars: int = 150) -> DataFrame:
    """Net chance of a higher close in 10 bars from the recent candles, against
    the base rate, with a conflict flag and the patterns whose edge differs in
    the last ``window`` bars."""
    full = keep(_read(bars, E.candle_backtest(bars)))
    recent = keep(_read(bars, E.candle_backtest(bars, tail=window)))
    n = bars.groupBy("symbol").agg(F.count("close").alias("__n"))
    t = _tilt(full)
    r = _tilt(recent).select("symbol", F.col("p_up").alias("p_up_recent"), (100.0 * (F.col("p_up") - F.col("base_up"))).alias("tilt_recent_pp"))
    e0 = full.groupBy("symbol", "name").agg(F.first("edge").alias("edge"))
    e1 = recent.groupBy("symbol", "name").agg(F.first("edge").alias("edge_recent"))
    moved = (F.signum("edge") != F.signum("edge_recent")) | (F.abs(F.col("edge") - F.col("edge_recent")) > 0.15)
    flips = e0.join(e1, ["symbol", "name"]).where(moved).groupBy("symbol").agg(F.count(F.lit(1)).alias("__flips"))
    x = n.where(F.col("__n") >= min_bars).join(t, "symbol", "left").join(r, "symbol", "left").join(flips, "symbol", "left")
    tilt = 100.0 * (F.col("p_up") - F.col("base_up"))
    long = F.col("__n") > window + 60
    return x.select(
        "symbol",
        F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
        "p_up",
        F.col("base_up").alias("baseline_up"),
        F.coalesce(tilt, F.lit(0.0)).alias("tilt_pp"),
        F.when(tilt > 2, "BULLISH").when(tilt < -2, "BEARISH").when(tilt.isNotNull(), "FLAT").alias("direction"),
        w.flag(F.col("bull_w").between(0.35, 0.65)).alias("conflict"),
        F.when(long, F.col("p_up_recent")).alias("p_up_recent"),
        F.when(long, F.col("tilt_recent_pp")).alias("tilt_recent_pp"),
        F.when(long & F.col("n_signals").isNotNull(), F.coalesce("__flips", F.lit(0))).alias("unstable_patterns"),
    )


def pattern_contributors(bars: DataFrame, k: int = 3) -> DataFrame:
    """The heaviest recent candles of each symbol's read."""
    x = _read(bars, E.candle_backtest(bars)).withColumn("pull", F.abs(F.col("p_up") - F.col("base_up")) * F.col("w"))
    spec = Window.partitionBy("symbol").orderBy(F.desc("pull"), "bars_ago", "rank")
    return (
        x.withColumn("pos", F.row_number().over(spec))
        .where(F.col("pos") <= k)
        .select("symbol", F.col("pos").cast("long").alias("pos"), "name", "bias", "bars_ago", "samples", "win_rate", "edge", "p_up", "w")
    )


def alert_rules(rules: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rules (rule_id, symbol, type, value) evaluated on the latest snapshot
    (rsi, close, confidence, verdict, passes, stage, cross)."""
    x = rules.join(snapshot, "symbol")
    t, v = F.col("type"), F.col("value")
    fired = (
        F.when(t == "rsi_below", F.col("rsi") < v)
        .when(t == "rsi_above", F.col("rsi") > v)
        .when(t == "price_below", F.col("close") < v)
        .when(t == "price_above", F.col("close") > v)
        .when(t == "confidence_above", F.col("confidence") > v)
        .when(t == "verdict_buy", F.col("verdict") == "BUY")
        .when(t == "verdict_sell", F.col("verdict") == "SELL")
        .when(t == "stage2", w.flag(F.col("passes")) | w.flag(F.col("stage") == 2))
        .when(t == "golden", F.col("cross") == "golden")
        .when(t == "death", F.col("cross") == "death")
    )
    return x.select("rule_id", "symbol", "type", "value", w.flag(fired).alias("fired"))


def compare_symbols(snapshot: DataFrame, pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """Chosen metrics of two symbols side by side."""
    long = snapshot.select("symbol", *[F.col(m).cast("string").alias(m) for m in metrics]).unpivot(["symbol"], metrics, "metric", "v")
    a = long.select(F.col("symbol").alias("a"), "metric", F.col("v").alias("value_a"))
    b = long.select(F.col("symbol").alias("b"), "metric", F.col("v").alias("value_b"))
    return pairs.join(a, "a").join(b, ["b", "metric"]).select("a", "b", "metric", "value_a", "value_b")


def recent_move(bars: DataFrame) -> DataFrame:
    """Five-bar change in words and the newest candle of the last three bars."""
    g = R.aged(bars).groupBy("symbol").agg(
        (w.ratio(R.at(0), F.coalesce(R.at(5), F.min_by("close", "ts"))) - 1.0).alias("change5"),
        (R.at(0) >= R.at(0, "open")).alias("up_day"),
    )
    c = F.col("change5") * 100
    move = (
        F.when(c > 4, "strong_push").when(c > 1, "drifting_up").when(c < -4, "sharp_drop").when(c < -1, "drifting_down").otherwise("flat")
    )
    cd = C.newest(C.events(bars, 3), 1).select("symbol", F.col("name").alias("candle"), F.col("bias").alias("candle_bias"))
    return g.withColumn("move", move).join(cd, "symbol", "left").select("symbol", "change5", "move", "up_day", "candle", "candle_bias")


def scan(bars: DataFrame, benchmark: DataFrame, h: int = 21, payload: bool = False) -> DataFrame:
    """The ranked universe: setup score with the reversal bonus, dip bucket,
    breakout watch and the plan's levels for the holding horizon.

    ``payload`` adds excess return, the dip's RSI, record and plan, and the watch's level and distance."""
    x = R.aged(I.rsi(bars))
    g = x.groupBy("symbol").agg(
        F.count("close").alias("__n"),
        R.at(0).alias("price"),
        R.at(0, "rsi").alias("rsi"),
        R.tail(F.avg, 20).alias("__s20"),
        R.tail(F.avg, 200).alias("__s200"),
    ).where(F.col("__n") >= 210)
    rs = R.relative_strength(bars, benchmark).select("symbol", F.col("excess").alias("rs_excess"))
    rev = C.events(bars, 4).groupBy("symbol").agg(F.max(F.col("bias") == "bullish").alias("reversal"))
    more = {"dip_rsi2": "rsi2", "dip_n_trades": "n_trades", "dip_avg": "avg_per_trade", "dip_bounce": "typical_bounce", "dip_target": "target", "dip_stop": "stop"}
    dip = TR.dip_state(bars).select(
        "symbol", F.lit(True).alias("__dip"), "active", F.col("in_uptrend").alias("__up"), F.col("win_rate").alias("dip_win_rate"), *(F.col(c).alias(a) for a, c in more.items())
    )
    levels = {"watch_level": "level", "watch_dist": "dist", "watch_overbought": "overbought", "watch_overhead_200": "overhead_200", "watch_dist_200": "dist_200"}
    bw = R.breakout_watch(bars).select("symbol", F.col("status").alias("watch"), F.col("fresh").alias("watch_fresh"), *(F.col(c).alias(a) for a, c in levels.items()))
    pl = TP.trade_plan(bars, h).select("symbol", "target", "stop", "p_profit_intraperiod", "weekly_vol")
    out = g
    for other in (rs, rev, dip, bw, pl):
        out = out.join(keep(other), "symbol", "left")
    ex = F.coalesce("rs_excess", F.lit(-0.99))
    score = X.setup_score(F.col("rsi"), F.col("price"), F.col("__s20"), F.col("__s200"), ex, F.col("reversal"))
    bucket = F.when(w.flag(F.col("active")), "active").when(w.flag(F.col("__dip") & F.col("__up")), "waiting").when(w.flag(F.col("__dip")), "downtrend")
    return out.select(
        "symbol",
        "price",
        score.alias("setup_score"),
        (F.col("price") > F.col("__s200")).alias("in_uptrend"),
        (ex > 0).alias("outperforming"),
        "rsi",
        w.flag(F.col("reversal")).alias("reversal"),
        (F.col("price") * (1 - 0.5 * F.coalesce("weekly_vol", F.lit(0.0)))).alias("buy_zone_low"),
        "target",
        "stop",
        "p_profit_intraperiod",
        bucket.alias("dip_bucket"),
        "dip_win_rate",
        "watch",
        "watch_fresh",
        *(["rs_excess", *more, *levels] if payload else []),
    )


def scan_lists(scanned: DataFrame, k: int = 5) -> DataFrame:
    """The scan's sorted lists, one row per entry: (list, pos, symbol, key).

    Live dips by win rate, waiting ones by RSI, symbols whose dip record has no uptrend; bases broken (fresh ones first, then
    the farthest) and coiling (the nearest first); the ``k`` best setups.  A list holds symbols, not bars."""
    bucket, watch = F.col("dip_bucket"), F.col("watch")
    rsi2, dist = F.coalesce("dip_rsi2", F.lit(99.0)), F.col("watch_dist")
    zero = F.lit(0.0)
    # fixed values: list names
    cells = [
        ("dip_active", bucket == "active", -F.coalesce("dip_win_rate", zero), zero),
        ("dip_waiting", bucket == "waiting", rsi2, zero),
        ("dip_downtrend", bucket == "downtrend", zero, zero),
        ("watch_broke", watch == "broke", (~F.col("watch_fresh")).cast("double"), -dist),
        ("watch_coiling", watch == "coiling", -dist, zero),
        ("top", F.col("setup_score") > 0, -F.col("setup_score"), zero),
    ]
    rows = [F.when(w.flag(c), F.struct(F.lit(n).alias("list"), a.cast("double").alias("__a"), b.cast("double").alias("__b"))) for n, c, a, b in cells]
    x = scanned.select("symbol", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    spec = Window.partitionBy("list").orderBy("__a", "__b", "symbol")
    x = x.withColumn("pos", F.row_number().over(spec).cast("long"))
    return x.where((F.col("list") != "top") | (F.col("pos") <= k)).select("list", "pos", "symbol")


def top_setups(scanned: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` setups with a positive score."""
    return scanned.where(F.col("setup_score") > 0).orderBy(F.desc("setup_score"), "symbol").limit(k)
