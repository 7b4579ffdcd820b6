"""Record-level behaviour of the streaming jobs."""

from __future__ import annotations

import datetime as dt

from tapeline.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, price double, qty double"


def _trades(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(hours=h), float(p), 1.0) for s, h, p in rows], SCHEMA)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_quote_has_the_close_before_and_the_range_of_the_day(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(_trades(spark, [("A", 1, 10), ("A", 5, 12), ("B", 2, 7)]), path)
    _write(_trades(spark, [("A", 25, 15), ("A", 30, 9), ("A", 3, 50)]), path)  # one trade of the first day comes late
    table = J.run_to_table(J.day_quotes(_stream(spark, path)), "day_quotes", "complete")
    got = {r.symbol: r for r in J.live_quotes(spark.read.parquet(table)).collect()}
    a, b = got["A"], got["B"]
    assert (a.price, a.prev_close, a.day_high, a.day_low, a.trades) == (9.0, 12.0, 15.0, 9.0, 2)
    assert a.change == 9.0 / 12.0 - 1 and b.prev_close is None and b.change is None


def test_bars_drop_what_comes_after_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(_trades(spark, [("A", 0.1, 10), ("A", 0.5, 11), ("A", 9, 12)]), path)
    _write(_trades(spark, [("A", 20, 13)]), path)
    _write(_trades(spark, [("A", 0.7, 99), ("A", 40, 14)]), path)  # hour 0 is closed by now
    out = spark.read.parquet(J.run_to_table(J.stream_bars(_stream(spark, path)), "bars")).orderBy("ts").collect()
    assert [(r.open, r.high, r.close, r.volume) for r in out][:2] == [(10.0, 11.0, 11.0, 2.0), (12.0, 12.0, 12.0, 1.0)]


def test_repeated_calls_are_logged_once(spark, tmp_path):
    path = str(tmp_path / "in")
    calls = spark.createDataFrame([("A", T0, "dip"), ("A", T0 + dt.timedelta(hours=1), "dip"), ("A", T0, "tilt")], "symbol string, ts timestamp, signal_type string")
    for _ in range(3):
        _write(calls, path)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = spark.read.parquet(J.run_to_table(J.ledger_ingest(stream), "ledger")).collect()
    assert sorted(r.signal_type for r in got) == ["dip", "tilt"]


def test_a_spike_is_twice_the_mean_of_fifty_days(spark):
    daily = spark.createDataFrame([("A", T0 + dt.timedelta(days=k), 1000.0 if k < 30 else 10.0) for k in range(80)], "symbol string, ts timestamp, volume double")
    mean = J.mean_volume(daily)
    assert mean.first().avg_volume == 10.0  # the newest fifty only
    trades = _trades(spark, [("A", 0.5, 1)] * 19 + [("A", 48.5, 1)] * 20)
    got = J.sliding_volume(trades, mean, slide="1 day").collect()
    assert [(r.start, r.volume, r.vol_ratio) for r in got] == [(T0 + dt.timedelta(days=2), 20.0, 2.0)]
