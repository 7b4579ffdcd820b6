"""Published tables through crashes and rival writers; folds through any cut; user masks."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline import schemas
from tapeline.operators import ledger as L
from tapeline.operators import replay as R
from tapeline.plans.extensions import one_at_a_time
from tapeline.sources import snapshots as SN


def _calls(spark, rows):
    return spark.createDataFrame([(dt.datetime(2024, m, d), s, k, "up", None, 1.0, None) for m, d, s, k in rows], schemas.LEDGER)


def _keys(df):
    return sorted((r.ts.month, r.ts.day, r.symbol, r.signal_type) for r in df.collect())


def test_ledger_appends_once_and_by_month(spark, tmp_path):
    path = str(tmp_path / "l")
    a, b = [(1, 1, "A", "x"), (2, 1, "A", "x")], [(2, 1, "A", "x"), (2, 2, "A", "x"), (3, 1, "B", "y")]
    assert L.append_published(_calls(spark, a + a), path) == 1
    january = SN.current(spark, path)[1]["2024-01"]
    assert L.append_published(_calls(spark, b), path) == 2
    assert _keys(L.read_published(spark, path)) == sorted(set(a + b))
    assert SN.current(spark, path)[1]["2024-01"] == january
    assert _keys(L.read_published(spark, str(tmp_path / "none"))) == []


def test_a_crash_between_the_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    L.append_published(_calls(spark, [(1, 1, "A", "x")]), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SN, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            L.append_published(_calls(spark, [(1, 2, "A", "x")]), path)
    assert _keys(L.read_published(spark, path)) == [(1, 1, "A", "x")]
    # A manifest that was begun and never finished.
    (tmp_path / "l" / "_manifest" / f"{2:012d}").write_text('{"2024-01": "data/no')
    assert _keys(L.read_published(spark, path)) == [(1, 1, "A", "x")]
    assert L.append_published(_calls(spark, [(1, 2, "A", "x")]), path) == 3
    assert _keys(L.read_published(spark, path)) == [(1, 1, "A", "x"), (1, 2, "A", "x")]


def test_rival_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    L.append_published(_calls(spark, [(1, 1, "A", "x")]), path)
    seen, parts = SN.current(spark, path)
    staged = SN.stage(_calls(spark, [(1, 9, "Z", "x")]), path)
    SN.publish(spark, path, seen, parts)
    with pytest.raises(SN.Conflict):
        SN.publish(spark, path, seen, staged)
    # The loser of a race reads the winner's rows and adds its own.
    real, raced = SN.publish, []

    def race(*a):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(SN, "publish", real)
            L.append_published(_calls(spark, [(1, 3, "W", "x")]), path)
            monkeypatch.setattr(SN, "publish", race)
        return real(*a)

    monkeypatch.setattr(SN, "publish", race)
    L.append_published(_calls(spark, [(1, 4, "L", "x")]), path)
    assert _keys(L.read_published(spark, path)) == [(1, 1, "A", "x"), (1, 3, "W", "x"), (1, 4, "L", "x")]


def test_replay_is_the_same_however_rows_are_cut(spark):
    rows = [("a", k, 3 if k % 7 else None, float(k)) for k in range(1, 60) if k % 3] + [("b", 5, 1, 1.0), (None, 2, 1, 2.0), (None, 3, 9, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, i long, held long, ret double")
    schema = "symbol string, i long, held long, ret double"

    def plain(key):
        free, out = -1, []
        for s, i, held, ret in sorted(r for r in rows if r[0] == key):
            if i > free:
                free = 2**62 if held is None else i + held
                out += [] if held is None else [(s, i, held, ret)]
        return out

    want = sorted(plain("a") + plain("b") + plain(None), key=str)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "4", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = R.replay(df, ["symbol"], ["i"], lambda: -1, one_at_a_time, schema).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    reach = F.coalesce(F.col("i") + F.col("held"), F.lit(2**62))
    got = R.replay(df, ["symbol"], ["i"], lambda: -1, one_at_a_time, schema, reach).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    n = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 9, 9), ("a", 10, 12), ("a", 12, 12)], "symbol string, i long, to long")
    assert [r[R.ISLAND] for r in R.with_islands(n, ["symbol"], "i", F.col("to")).orderBy("i").collect()] == [0, 0, 1, 2, 2]


def test_transition_of_an_empty_piece():
    free, out = one_at_a_time(7, pd.DataFrame({"symbol": [], "i": [], "held": [], "ret": []}))
    assert free == 7 and not len(out)
