"""As-of patterns and candle records against the newest-bar operators on cut histories."""

import random

from pyspark.sql import functions as F

from tapeline.functions import windows as w
from tapeline.operators import asof_events as A
from tapeline.operators import asof_patterns as AP
from tapeline.operators import candles as C
from tapeline.operators import evaluations as E
from tapeline.operators import patterns as PT


def _walk(bars, n, seed):
    r = random.Random(seed)
    c, closes = 100.0, []
    for _ in range(n):
        c *= 1 + r.gauss(0, 0.02)
        closes.append(round(c, 2))
    opens = [closes[0], *[round(x * (1 + r.gauss(0, 0.008)), 2) for x in closes[:-1]]]
    highs = [max(o, x) * (1 + abs(r.gauss(0, 0.004))) for o, x in zip(opens, closes)]
    lows = [min(o, x) * (1 - abs(r.gauss(0, 0.004))) for o, x in zip(opens, closes)]
    return bars(closes, highs, lows, opens)


def _value(bias):
    return {"bullish": 1.0, "bearish": -1.0}.get(bias, 0.0)


def test_patterns_of_each_chart(bars):
    b = _walk(bars, 420, 5).withColumn("i", w.bar_no())
    at = list(range(260, 420, 23))
    asked = b.where(F.col("i").isin(at)).select("symbol", "i")
    got = {r.i: r.patterns for r in AP.pattern_votes(b.select("symbol", "ts", "i", "close"), asked).collect()}
    for t in at:
        cut = PT.chart_patterns(b.where(F.col("i") <= t).drop("i"), bars=260).where("pos <= 3").collect()
        want = sum(_value(r.bias) for r in cut) / 3.0 if cut else None
        assert got.get(t) is None if want is None else abs(got[t] - want) < 1e-12, t
    assert any(got.values())


def test_candles_scaled_by_what_was_known(bars):
    b = _walk(bars, 200, 9).withColumn("i", w.bar_no())
    hits = C.with_hits(b).select("symbol", "i", F.inline("hits")).drop("strength").cache()
    at = [60, 97, 150, 199]
    asked = b.where(F.col("i").isin(at)).select("symbol", "i")
    got = {r.i: r.candles for r in A.candle_votes(b.select("symbol", "ts", "i", "close"), hits, asked).collect()}
    hits.unpersist()
    for t in at:
        cut = b.where(F.col("i") <= t).drop("i")
        edge = {(r.name, r.bias): r.edge for r in E.candle_backtest(cut).where("horizon = 10").collect()}
        top = C.detect(cut).where("pos <= 3").collect()
        size = [(0.4 + 2 * max(0.0, edge.get((r.name, r.bias), 0.0)), 1.0 - 0.3 * (r.pos - 1)) for r in top]
        want = sum(_value(r.bias) * s * k for r, (s, k) in zip(top, size)) / sum(k for _, k in size)
        assert abs(got[t] - want) < 1e-9, t


def test_newest_events_order_and_reach(spark):
    ev = spark.createDataFrame([("X", 3, 1, "b"), ("X", 3, 0, "a"), ("X", 1, 0, "c"), ("Y", 9, 0, "d")], "symbol string, i long, rank int, name string")
    asked = spark.createDataFrame([("X", 3), ("X", 2), ("X", 0), ("X", 42), ("X", 43), ("Y", 8)], "symbol string, i long")
    got = sorted((r.symbol, r.t, r.pos, r.name) for r in A.newest_events(asked, ev, 2, 40).collect())
    assert got == [("X", 2, 0, "c"), ("X", 3, 0, "a"), ("X", 3, 1, "b"), ("X", 42, 0, "a"), ("X", 42, 1, "b")]
