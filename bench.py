"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Derived tables are forgotten before every query, so each time starts at the
given tables.  The result is written to the no-op sink: all rows are computed,
none are collected."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bars_daily",
    "ma_regime",
    "compute_all",
    "vol_series",
    "candle_events",
    "candle_backtest",
    "recovery_signals",
    "volume_breakouts",
    "momentum_study",
    "trade_plan",
    "dip_trades",
    "strategy_lab",
    "sector_pulse",
    "resistance_state",
    "score_forward",
    "look_through",
    "portfolio_drawdown",
]


def main() -> None:
    from tapeline.plans import QUERIES, panels
    from tapeline.session import local_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tapeline-bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ma_regime"].run(spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        panels.release()
        t0 = time.perf_counter()
        QUERIES[name].run(spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
