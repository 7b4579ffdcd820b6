"""Linear recurrences (EMA, Wilder averages, EWMA variance) without a UDF.

``y_t = q*y_{t-1} + (1-q)*x_t`` with ``y_0 = x_0`` unrolls to a weighted sum.
Summing ``u_j * q**-j`` over a whole history overflows, so the history is cut
into chunks whose weights stay far inside the double range:

1. inside a chunk a plain running window sum gives the local part,
2. the local values at earlier chunk ends add up to a carry by the same weighted
   sum over blocks of chunks, blocks of blocks, and so on until one step of the
   decay leaves nothing,
3. ``y = local + carry * q**(k+1)``.

Every step partitions by the symbol and more.  Hash partitioning on the symbol
satisfies them all, so a scan adds sorts but no exchange, and no row carries
more than a number however long the history is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import KEY, TS, col

MAX_CHUNK = 4096
#: A decay below this leaves nothing of a double.
NOTHING = 1e-40


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def chunk_length(alphas: Sequence[float]) -> int:
    steepest = min(1.0 - a for a in alphas)
    if steepest <= 0:
        raise ValueError("alpha must lie in (0, 1)")
    return max(8, min(MAX_CHUNK, int(90 * math.log(10) / -math.log(steepest))))


def carried(df: DataFrame, end: str, at: str, decay: float, out: str, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``out``: the sum of ``end[j] * decay**(at - 1 - j)`` over all steps j < ``at``.

    ``end`` is not NULL on one row of each step, the last.  The depth of the
    recursion depends on the decay alone."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if decay <= NOTHING:
        return df.withColumn(out, F.coalesce(F.last(end, ignorenulls=True).over(past), F.lit(0.0)))
    size = min(128, int(150 / -math.log10(decay)))
    b, place, total, upper = f"{out}_b", f"{out}_p", f"{out}_t", f"{out}_u"
    own = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    q, p = F.lit(decay), F.col(place)
    x = df.withColumn(b, F.floor(F.col(at) / size)).withColumn(place, (F.col(at) - F.col(b) * size).cast("double"))
    x = x.withColumn(out, F.coalesce(F.sum(F.col(end) * F.pow(q, -p)).over(own), F.lit(0.0)) * F.pow(q, p - 1.0))
    x = x.withColumn(total, F.when(p == size - 1, F.col(out) * q + F.col(end)))
    x = carried(x, total, b, decay**size, upper, keys, order)
    return x.withColumn(out, F.col(out) + F.col(upper) * F.pow(q, p)).drop(b, place, total, upper)


def ewm(
    df: DataFrame,
    columns: Mapping[str, tuple[str | Column, float]],
    keys: str | Sequence[str] = KEY,
    order: str = TS,
) -> DataFrame:
    """Add one exponentially weighted column per entry of ``columns``
    (``name -> (input, alpha)``).

    Inputs may be NULL only on a common leading run of rows of a symbol; the
    first non-null value seeds the recurrence and the leading rows stay NULL.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = list(columns)
    ordered = Window.partitionBy(*keys).orderBy(order)
    size = chunk_length([a for _, a in columns.values()])
    out = df.columns + names

    work = df
    for n, (c, _) in columns.items():
        work = work.withColumn(f"__x_{n}", col(c).cast("double"))
    started = F.greatest(*[F.count(f"__x_{n}").over(ordered) for n in names], F.lit(0))
    work = work.withColumn("__i", started - 1)
    work = work.withColumn("__c", F.floor(F.col("__i") / F.lit(size)))
    work = work.withColumn("__k", F.col("__i") - F.col("__c") * size)

    chunk = (
        Window.partitionBy(*keys, "__c")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    k = F.col("__k").cast("double")
    for n, (_, a) in columns.items():
        q = 1.0 - a
        u = F.when(F.col("__i") == 0, F.col(f"__x_{n}")).otherwise(F.col(f"__x_{n}") * F.lit(a))
        local = F.sum(u * F.pow(F.lit(q), -k)).over(chunk) * F.pow(F.lit(q), k)
        work = work.withColumn(f"__l_{n}", F.when(F.col("__i") >= 0, local))

    for n, (_, a) in columns.items():
        q = 1.0 - a
        work = work.withColumn(f"__e_{n}", F.when(F.col("__k") == size - 1, F.col(f"__l_{n}")))
        work = carried(work, f"__e_{n}", "__c", q**size, f"__y_{n}", keys, order)
        work = work.withColumn(n, F.col(f"__l_{n}") + F.col(f"__y_{n}") * F.pow(F.lit(q), k + 1.0))
    return work.select(*out)


def ema(df: DataFrame, spans: Mapping[str, tuple[str | Column, int]], **kw) -> DataFrame:
    return ewm(df, {n: (c, span_alpha(s)) for n, (c, s) in spans.items()}, **kw)
