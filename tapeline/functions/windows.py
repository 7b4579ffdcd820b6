"""Window helpers shared by every operator.

Everything ordered is expressed on ONE canonical specification,
``partitionBy(symbol).orderBy(ts)``, so Catalyst plans a single exchange and a
single sort for a whole stack of indicators.

A symbol partition is bounded by the calendar, not by the trade count: bars
are unique per (symbol, interval), and they are pre-aggregated map-side by
``bars_from_trades``.  A symbol with a third of all trades therefore still
owns only one row per interval here.  Series that are long in *intervals* use
``operators.chunks``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "symbol"
TS = "ts"


def by(keys: str | Sequence[str] = KEY, order: str = TS) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: str | Sequence[str] = KEY) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys)


def trailing(w: int, shift: int = 0, keys: str | Sequence[str] = KEY) -> WindowSpec:
    """The ``w`` rows ending ``shift`` rows before the current one."""
    return by(keys).rowsBetween(-(w - 1) - shift, -shift)


def ahead(first: int, last: int, keys: str | Sequence[str] = KEY) -> WindowSpec:
    """Rows ``first`` .. ``last`` after the current one."""
    return by(keys).rowsBetween(first, last)


def history(keys: str | Sequence[str] = KEY, shift: int = 0) -> WindowSpec:
    return by(keys).rowsBetween(Window.unboundedPreceding, -shift)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def roll(
    agg: Callable[[Column], Column],
    c: str | Column,
    w: int,
    shift: int = 0,
    min_periods: int | None = None,
    keys: str | Sequence[str] = KEY,
) -> Column:
    """Rolling aggregate that is NULL until ``min_periods`` non-null values exist
    (default: the full window)."""
    spec = trailing(w, shift, keys)
    need = w if min_periods is None else min_periods
    return F.when(F.count(col(c)).over(spec) >= need, agg(col(c)).over(spec))


def lag(c: str | Column, n: int = 1, keys: str | Sequence[str] = KEY) -> Column:
    return F.lag(col(c), n).over(by(keys))


def lead(c: str | Column, n: int = 1, keys: str | Sequence[str] = KEY) -> Column:
    return F.lead(col(c), n).over(by(keys))


def bar_no(keys: str | Sequence[str] = KEY) -> Column:
    """0-based ordinal of a bar inside its symbol."""
    return (F.row_number().over(by(keys)) - 1).cast("long")


def n_bars(keys: str | Sequence[str] = KEY) -> Column:
    """Bars of the symbol.  The full frame keeps the ordered specification, so
    it shares the one sort with every other column."""
    spec = by(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.count(F.lit(1)).over(spec)


def bars_ago(keys: str | Sequence[str] = KEY) -> Column:
    """0 on the newest bar of a symbol, counted without a second sort order."""
    return (n_bars(keys) - 1 - bar_no(keys)).cast("long")


def ratio(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL for a zero or NULL divisor (ANSI mode raises)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ret(a: str | Column, b: str | Column) -> Column:
    return ratio(a, b) - 1.0


def ln(c: Column) -> Column:
    """Natural logarithm, NULL outside the domain."""
    return F.when(c > 0, F.log(c))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def flag(c: Column) -> Column:
    """Comparison with NULL counted as False, as in a boolean mask panel."""
    return F.coalesce(c, F.lit(False))
