"""Daily volatility estimators per bar, and a registry users can extend."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import windows as w

WINDOW = 20
LAMBDA = 0.94
LN2 = math.log(2.0)
EWMA_MIN_BARS = 30
FLOOR = 1e-12


def _l(a: str, b: str) -> Column:
    return w.ln(w.ratio(a, b))


def _root(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def prepared(df: DataFrame) -> DataFrame:
    """Per-bar terms every estimator averages."""
    prev = w.lag("close")
    return df.withColumns(
        {
            "__r": w.ln(w.ratio("close", prev)),
            "__on": w.ln(w.ratio("open", prev)),
            "__oc": _l("close", "open"),
            "__pk": _l("high", "low") ** 2,
            "__gk": 0.5 * _l("high", "low") ** 2 - (2 * LN2 - 1) * _l("close", "open") ** 2,
            "__rs": _l("high", "close") * _l("high", "open") + _l("low", "close") * _l("low", "open"),
        }
    )


def with_ewma_var(df: DataFrame, out: str = "ewma_var", lam: float = LAMBDA) -> DataFrame:
    """Variance recurrence seeded with the first squared return."""
    return scan.ewm(df.withColumn("__r2", F.col("__r") ** 2), {out: ("__r2", 1.0 - lam)}).drop("__r2")


def yz_var(n: int = WINDOW) -> Column:
    """Overnight variance + k * open-close variance + (1-k) * mean RS term."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    ready = F.count("__on").over(w.trailing(n)) >= n
    on = F.var_samp("__on").over(w.trailing(n))
    oc = F.var_samp("__oc").over(w.trailing(n))
    rs = F.avg("__rs").over(w.trailing(n))
    return F.when(ready, on + F.lit(k) * oc + F.lit(1 - k) * rs)


Estimator = Callable[[int], Column]

# name -> expression over the prepared columns and ``ewma_var``
ESTIMATORS: dict[str, Estimator] = {
    "close_to_close": lambda n: w.roll(F.stddev_samp, "__r", n),
    "ewma": lambda n: F.when(w.bar_no() >= EWMA_MIN_BARS - 1, F.sqrt("ewma_var")),
    "parkinson": lambda n: F.sqrt(w.roll(F.avg, "__pk", n) / (4 * LN2)),
    "garman_klass": lambda n: _root(w.roll(F.avg, "__gk", n)),
    "rogers_satchell": lambda n: _root(w.roll(F.avg, "__rs", n)),
    "yang_zhang": lambda n: _root(yz_var(n)),
    "blend": lambda n: blend(n),
}


def register(name: str, build: Estimator) -> None:
    """Plug in an estimator: a Column builder, no Python in the hot path."""
    ESTIMATORS[name] = build


def blend(n: int = WINDOW) -> Column:
    """sqrt(half Yang-Zhang + half EWMA variance); EWMA alone while YZ is not
    usable; NULL while EWMA is NULL."""
    ev = F.col("ewma_var")
    yz = F.coalesce(yz_var(n), ev)
    return F.when(ev.isNotNull(), F.sqrt(F.greatest(0.5 * yz + 0.5 * ev, F.lit(FLOOR))))


def with_blend(df: DataFrame, out: str = "sigma", n: int = WINDOW) -> DataFrame:
    """Adds the blended daily volatility and drops the working columns."""
    keep = df.columns
    return with_ewma_var(prepared(df)).withColumn(out, blend(n)).select(*keep, out)


def series(df: DataFrame, names: list[str] | None = None, n: int = WINDOW) -> DataFrame:
    """Every requested estimator as a column of the bar frame, in one pass."""
    names = names or list(ESTIMATORS)
    keep = df.columns
    x = with_ewma_var(prepared(df))
    return x.withColumns({f"vol_{m}": ESTIMATORS[m](n) for m in names}).select(*keep, *[f"vol_{m}" for m in names])


def latest(df: DataFrame, names: list[str] | None = None, n: int = WINDOW) -> DataFrame:
    """(symbol, estimator, value) on the newest bar."""
    names = names or list(ESTIMATORS)
    x = series(df, names, n).withColumn("__a", w.bars_ago()).where(F.col("__a") == 0)
    return x.unpivot(["symbol"], [F.col(f"vol_{m}").alias(m) for m in names], "estimator", "value").where(
        F.col("value").isNotNull()
    )
