"""Registered queries against their SQL text on the smallest tables."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

DATA = "/root/testdata/sf0.001"
# one query per operator family keeps this suite short; ``oracle.py`` runs all
SAMPLE = [
    "bars_daily", "calendar", "ema", "macd", "vol_estimators", "candles_recent", "volume_analysis", "resistance_state", "trade_plan", "dip_trades",
    "position_walk", "sector_pulse", "gap_universe", "look_through", "import_positions_csv", "parse_form4", "stream_bars", "edge_alerts", "chunked_rolling", "posture_series", "posture_returns",
]


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = oracle.connect(DATA)
    ok, text = oracle.compare(queries()[name](spark, DATA), con, oracle_sql()[name])
    assert ok, text
