"""Who counts in a sector: a minimum of bars, and half of the members."""

import datetime as dt

from tapeline.operators import crosssection as X
from tapeline.plans import crosssection as C


def _frame(spark, lengths):
    rows = [(f"S{k}", "x", dt.datetime(2020, 1, 1) + dt.timedelta(days=60 - n + i), 100.0 + (i * (k + 3)) % 7) for k, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, sector string, ts timestamp, close double")


def test_members_count_from_their_25th_bar(spark):
    last = X.sector_pulse(_frame(spark, [60] * 5 + [24])).where("ts = '2020-02-29'").collect()
    assert sorted(r.symbol for r in last) == [f"S{k}" for k in range(5)] and {r.n_members for r in last} == {5}
    assert X.sector_pulse(_frame(spark, [24] * 6)).count() == 0


def test_half_of_the_members_must_count(spark):
    assert X.sector_pulse(_frame(spark, [60] * 4 + [10] * 6)).count() == 0
    assert X.sector_pulse(_frame(spark, [60] * 5 + [10] * 5)).count() > 0


def test_attribution_needs_forty_dates(spark):
    assert X.move_attribution(_frame(spark, [39] * 5), big=0.0).count() == 0
    # S4 never moves, so it correlates with nobody.
    assert sorted(r.symbol for r in X.move_attribution(_frame(spark, [41] * 5), big=0.0).collect()) == ["S0", "S1", "S2", "S3"]


def test_the_query_has_every_member_day(spark):
    x = X.sector_pulse(_frame(spark, [60] * 5 + [24]), every=True)
    # 59 returns of five members and 23 of the sixth; from the 25th bar on five of six count.
    assert x.count() == 5 * 59 + 23
    assert {(r.symbol, r.available) for r in x.where("ts = '2020-02-29'").collect()} == {(f"S{k}", k < 5) for k in range(6)}
    assert x.where("available").count() == 5 * 36 and {r.n_members for r in x.where("ts = '2020-02-29'").collect()} == {6}


def test_sector_pulse_keeps_the_first_bars(spark, tmp_path):
    brands, days = range(12), range(30)
    part = [(b, f"Brand#{b}") for b in brands]
    line = [(n, 1, b, 1, 100.0 + (n * (b + 3)) % 7, 1.0, dt.datetime(2020, 1, 1) + dt.timedelta(days=n)) for b in brands for n in days]
    spark.createDataFrame(part, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = C.sector_pulse(spark, str(tmp_path))
    assert got.count() == 12 * 29 and got.where("available").count() == 12 * 6
