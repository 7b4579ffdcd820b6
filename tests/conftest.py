import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tapeline.session import local_session

    s = local_session("4", "tapeline-tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Builds a bar frame from closes (and optional highs, lows, opens, volumes)."""
    import datetime as dt

    def build(closes, highs=None, lows=None, opens=None, volumes=None, symbol="X"):
        rows = []
        for k, c in enumerate(closes):
            c = float(c)
            rows.append(
                (
                    symbol,
                    dt.datetime(2020, 1, 1) + dt.timedelta(days=k),
                    float(opens[k]) if opens else c,
                    float(highs[k]) if highs else c * 1.01,
                    float(lows[k]) if lows else c * 0.99,
                    c,
                    float(volumes[k]) if volumes else 1000.0,
                )
            )
        return spark.createDataFrame(
            rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
        )

    return build
