"""No pooled model may learn from dates after the origins it is used on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tapeline.operators import forecast as FC


def test_one_date_cuts_all_symbols(spark):
    rows = []
    for symbol, first, n in (("OLD", 0, 200), ("NEW", 150, 90)):  # the second one starts later and ends later
        for k in range(n):
            c = 100 + (k * 7 % 13) + 0.01 * k
            rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=first + k), c))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    cut = df.agg(F.expr("timestamp'2020-06-18'")).first()[0]
    train = FC.known_by(FC.training_rows(df), F.lit(cut))
    assert train.count() > 0 and train.where(F.col("target_ts") > F.lit(cut)).count() == 0
    by_date = df.select(FC.calendar_cut(df, 0.8).alias("c")).first().c
    assert by_date == dt.datetime(2020, 1, 1) + dt.timedelta(days=192)
    report = FC.fit_report(df, trees=3).collect()
    # every test row lies behind the cut, so the older symbol has its last week only
    assert {r.symbol: r.n_test for r in report} == {"OLD": 7, "NEW": 47}
    assert all(r.rmse > 0 for r in report)
