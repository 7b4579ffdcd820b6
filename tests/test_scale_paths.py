"""Long series, many candidates of one key, total losses and the ledger table."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.functions import scan
from tapeline.operators import chunks, crosssection, indicators, ledger, patterns, trades
from tapeline.plans import panels
from tapeline.plans import portfolio as portfolio_plans


@pytest.mark.parametrize("span", [5, 204, 2000])
def test_recurrence_of_any_length(spark, span):
    n = 60_000
    bars = spark.range(2 * n).select(
        F.concat(F.lit("S"), (F.col("id") % 2).cast("string")).alias("symbol"),
        F.timestamp_seconds((F.col("id") / 2).cast("long") * 60).alias("ts"),
        (F.col("id") / 2).cast("long").alias("i"),
        (100 + F.sin(F.col("id") * 0.37) * 5 + F.col("id") % 17).alias("close"),
    )
    a = 2 / (span + 1)
    plain = scan.ewm(bars, {"e": ("close", a)}).toPandas()
    split = chunks.ewm(bars, "close", a, "e").toPandas()
    for got in (plain, split):
        for _, g in got.groupby("symbol"):
            g = g.sort_values("i")
            want = g["close"].ewm(alpha=a, adjust=False).mean()
            assert np.allclose(g["e"], want, rtol=1e-11)


def test_spaced_events_of_one_hot_key(spark):
    rng = np.random.default_rng(4)
    at = np.cumsum(rng.integers(0, 9, 100_000))
    got = crosssection.keep_spaced(spark.createDataFrame([("k", int(x)) for x in at], "key string, at long"), ["key"], "at", 5, ["at"])
    want, last = [], None
    for x in at.tolist():
        if last is None or x - last > 5:
            want.append(x)
            last = x
    assert sorted(r.at for r in got.select("at").collect()) == want


def test_trades_that_do_not_overlap(spark):
    rng = np.random.default_rng(5)
    rows = [("S", int(i), None if i > 99_990 else int(rng.integers(1, 12)), 0.01) for i in range(0, 100_000, 3)]
    got = trades.non_overlapping(spark.createDataFrame(rows, "symbol string, i long, held long, ret double"))
    want, free = [], -1
    for _, i, held, _ in rows:
        if i > free:
            free = 2**62 if held is None else i + held
            if held is not None:
                want.append(i)
    assert sorted(r.i for r in got.collect()) == want


def test_a_total_loss_stays_one(spark):
    rows = [("S", dt.datetime(2020, 1, d + 1), r, 1.0) for d, r in enumerate([0.1, -1.0, 0.5, 0.2])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, sr double, pos double")
    got = trades.equity_stats(df, ["symbol"]).first()
    assert (got.total_return, got.max_drawdown) == (-1.0, -1.0)
    assert [r.c for r in df.select("ts", indicators.cum_return("sr").alias("c")).orderBy("ts").collect()][1:] == [0.0, 0.0, 0.0]


def test_charts_see_all_bars(bars):
    closes = [100 + (k % 20 if k % 40 < 20 else 20 - k % 20) for k in range(600)]
    whole = patterns.swing_extrema(patterns.chart_tail(bars(closes))).count()
    newest = patterns.swing_extrema(patterns.chart_tail(bars(closes), 260)).count()
    assert whole > 2 * newest > 0


def test_ledger_table(spark, tmp_path):
    fields = {f.name: f for f in ledger.schemas.LEDGER}
    path = str(tmp_path / "ledger")

    def signals(days):
        rows = [(day, "AAA", kind) for day in days for kind in ("dip_buy", "pattern_tilt")]
        df = spark.createDataFrame(rows, "ts timestamp, symbol string, signal_type string")
        rest = [F.lit(None).cast(f.dataType).alias(n) for n, f in fields.items() if n not in df.columns]
        return df.select(*df.columns, *rest).select(*fields)

    first = [dt.datetime(2020, 1, 30), dt.datetime(2020, 1, 31)]
    ledger.append(signals(first), path)
    ledger.append(signals(first), path)
    assert spark.read.parquet(path).count() == 4
    ledger.append(signals([dt.datetime(2020, 1, 31), dt.datetime(2020, 2, 1)]), path)
    table = spark.read.parquet(path)
    assert table.count() == 6 and {r.month for r in table.select("month").distinct().collect()} == {"2020-01", "2020-02"}
    bad = tmp_path / "broken"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ledger.append(signals(first), str(bad))
    assert (bad / "part-0.parquet").read_text() == "not parquet"


def test_growing_tables_are_not_broadcast(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df, joins in ((panels.part_trades(spark, d, "p_brand"), 1), (portfolio_plans._holdings(spark, d), 3), (portfolio_plans._fund_holdings(spark, d), 1)):
        assert plan(df).count("SortMergeJoin") >= joins
    assert "Broadcast" not in plan(panels.part_trades(spark, d, "p_brand"))
