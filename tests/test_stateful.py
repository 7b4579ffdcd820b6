"""Keyed stream jobs: slices, restarts, late rows, rules that change."""

from __future__ import annotations

import copy
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tapeline.streaming import jobs as J
from tapeline.streaming import stateful as ST

T0 = dt.datetime(2024, 1, 1)


def _closes(n, seed=1):
    r = random.Random(seed)
    c, out = 100.0, []
    for _ in range(n):
        c *= 1 + r.gauss(0.001, 0.015)
        out.append(c)
    return np.array(out)


def _plain(close, rules=ST.Rules()):
    """Bar by bar, as the rules are told."""
    ema = var = g = lo = g2 = l2 = prev = None
    held, ep, ei, dip, out = False, 0.0, 0, False, []
    for i, c in enumerate(close):
        go = dip
        ema = c if ema is None else ema + 2 / (rules.span + 1) * (c - ema)
        if i:
            up, down, r2 = max(c - prev, 0), max(prev - c, 0), np.log(c / prev) ** 2
            mix = lambda y, x, a: x if y is None else y + a * (x - y)
            var, g, lo, g2, l2 = mix(var, r2, 1 - rules.lam), mix(g, up, 1 / 14), mix(lo, down, 1 / 14), mix(g2, up, 0.5), mix(l2, down, 0.5)
        prev = c
        rsi = None if i < 14 else 50.0 if g == lo == 0 else 0.0 if g == 0 else 100.0 if lo == 0 else 100 - 100 / (1 + g / lo)
        rsi2 = None if not l2 else 100 - 100 / (1 + g2 / l2)
        dip = i >= rules.warm and rsi2 is not None and rsi2 < 15 and c > np.mean(close[i - 199 : i + 1])
        ret = None
        if held:
            x = c / ep - 1
            if c > np.mean(close[i - 4 : i + 1]) or x >= 0.06 or x <= -0.08 or i - ei >= 12:
                held, ret = False, x
        elif go:
            held, ep, ei = True, c, i
        out.append((ema, var, rsi, rsi2, held, ret))
    return out


def _same(a, b):
    if a is None or (isinstance(a, float) and np.isnan(a)):
        return b is None or np.isnan(b)
    return a == pytest.approx(b, rel=1e-9)


def test_slices_compose_to_the_bar_by_bar_walk():
    close = _closes(700)
    want = _plain(close)
    assert sum(w[5] is not None for w in want) > 3
    r = random.Random(4)
    for cuts in ([], [1, 2], [211], sorted(r.sample(range(1, 700), 40))):
        s, got = ST.Series(), []
        for part in np.split(close, cuts):
            out = ST.advance(s, part)
            s = copy.deepcopy(s)
            got += list(zip(*(out[k] for k in ("ema", "ewma_var", "rsi", "rsi2", "in_dip", "dip_ret")), strict=True))
        assert all(_same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_recurrence_limits():
    up, flat = ST.advance(ST.Series(), np.arange(1.0, 40.0)), ST.advance(ST.Series(), np.full(40, 7.0))
    assert up["rsi"][-1] == 100.0 and np.isnan(up["rsi2"][-1]) and flat["rsi"][-1] == 50.0 and flat["ewma_var"][-1] == 0.0
    assert ST.affine_scan(np.array([]), 0.5, 1.0).size == 0


def _bars(spark, rows, path):
    spark.createDataFrame([(s, T0 + dt.timedelta(hours=h), float(c)) for s, h, c in rows], "symbol string, ts timestamp, close double").coalesce(1).write.mode("append").parquet(path)


def _online(spark, path, to):
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").option("maxFilesPerTrigger", 1).parquet(path)
    with ST.keyed_state(spark):
        out = ST.online_state(stream)
        out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{to}/cp").format("parquet").option("path", f"{to}/out").start().awaitTermination()
    return spark.read.parquet(f"{to}/out").orderBy("symbol", "ts").collect()


def test_restart_and_late_rows(spark, tmp_path):
    path, to = str(tmp_path / "in"), str(tmp_path / "job")
    close = _closes(30, 7)
    rows = [("A", h, c) for h, c in enumerate(close)]
    # Out of order across files within the watermark; the job ends and starts again in between.
    _bars(spark, rows[:10] + rows[11:12], path)
    first = _online(spark, path, to)
    assert [r.ts for r in first] == [T0 + dt.timedelta(hours=h) for h in range(10)]
    _bars(spark, rows[10:11] + rows[12:], path)
    _bars(spark, [("A", 3, 1.0), ("B", 40, 5.0)], path)
    got = _online(spark, path, to)
    want = ST.advance(ST.Series(), np.delete(close, 10))
    # Bar 10 came when the watermark had reached it, bar 3 long after.
    assert [r.close for r in got if r.symbol == "A"] == pytest.approx(np.delete(close, 10).tolist())
    assert [r.ema for r in got if r.symbol == "A"] == pytest.approx(want["ema"].tolist())


FACTS = {"rsi": None, "close": None, "confidence": None, "verdict": None, "passes": None, "stage": None, "cross": None}


def _frame(rows):
    return pd.DataFrame([FACTS | r for r in rows])


@pytest.mark.parametrize(
    ("kind", "value", "yes", "no"),
    [
        ("rsi_below", 30.0, {"rsi": 29.0}, {"rsi": 30.0}), ("rsi_above", 70.0, {"rsi": 71.0}, {"rsi": None}), ("price_below", 5.0, {"close": 4.0}, {"close": 5.0}),
        ("price_above", 5.0, {"close": 6.0}, {"close": None}), ("confidence_above", 60.0, {"confidence": 61.0}, {"confidence": 60.0}), ("verdict_buy", None, {"verdict": "BUY"}, {"verdict": "HOLD"}),
        ("verdict_sell", None, {"verdict": "SELL"}, {"verdict": None}), ("stage2", None, {"passes": True}, {"passes": False, "stage": 4}), ("stage2", None, {"stage": 2}, {"passes": None}),
        ("golden", None, {"cross": "golden"}, {"cross": "death"}), ("death", None, {"cross": "death"}, {"cross": None}), ("price_above", None, {"close": 1.0, "rsi": 1.0}, {"close": 2.0}), ("unknown", 1.0, {}, {}),
    ],
)
def test_ten_conditions(kind, value, yes, no):
    got = ST.truth(kind, value, _frame([yes, no])).tolist()
    assert got == ([False, False] if kind == "unknown" or (kind == "price_above" and value is None) else [True, False])


def test_rules_fire_once_change_and_end(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(days=h)
    facts = "symbol string, ts timestamp, rsi double, close double, confidence double, verdict string, passes boolean, stage long, cross string"
    closes = [4, 6, 7, 4, 6, 6, 9, 4, 6, 6, 6]
    snaps = [("A", at(k), None, float(c), None, "BUY" if k in (2, 3, 6) else None, None, 2 if k == 5 else None, None) for k, c in enumerate(closes)]
    rules = [("p", "A", at(0), "price_above", 5.0, None), ("p", "A", at(5), "price_above", 8.0, None), ("v", "A", at(0), "verdict_buy", None, at(6)), ("s", "A", at(0), "stage2", None, None)]
    for k in range(0, len(snaps), 4):
        spark.createDataFrame(snaps[k : k + 4], facts).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    spark.createDataFrame(rules, "rule_id string, symbol string, ts timestamp, type string, value double, until timestamp").write.parquet(str(tmp_path / "r"))
    read = lambda p, n: spark.readStream.schema(spark.read.parquet(str(tmp_path / p)).schema).option("maxFilesPerTrigger", n).parquet(str(tmp_path / p))
    with ST.keyed_state(spark):
        got = spark.read.parquet(J.run_to_table(ST.stream_alerts(read("s", 1), read("r", 10)), "alerts")).collect()
    # p fires at 1 and 4, anew under its second value at 6; v at 2 and is over before 6; s at 5. The last day waits for the watermark.
    assert sorted((r.rule_id, (r.ts - T0).days) for r in got) == [("p", 1), ("p", 4), ("p", 6), ("s", 5), ("v", 2)]
