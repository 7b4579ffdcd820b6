"""Test statistics as plain column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import col, ratio


def t_one_sample(mean: Column, sd: Column, n: Column, min_n: int = 3) -> Column:
    """``mean / (sd / sqrt(n))``; NULL below ``min_n`` observations or for zero spread."""
    return F.when((n >= min_n) & (sd > 0), ratio(mean, ratio(sd, F.sqrt(n.cast("double")))))


def t_of(c: str | Column, min_n: int = 3) -> Column:
    """One-sample t of a column against zero, as an aggregate expression."""
    c = col(c)
    return t_one_sample(F.avg(c), F.stddev_samp(c), F.count(c), min_n)


def t_two_sample(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Student's pooled-variance t of two independent samples."""
    pooled = ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    se = F.sqrt(pooled * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
    return F.when((n1 > 1) & (n2 > 1) & (se > 0), ratio(m1 - m2, se))


def z_two_proportions(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    """z of two win rates with the pooled proportion."""
    pooled = ratio(p1 * n1 + p2 * n2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), ratio(p1 - p2, se))


def rate(c: Column) -> Column:
    """Share of True among non-null values."""
    return F.avg(c.cast("double"))


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation of the pairs without a NULL; NULL where a side does not vary (``F.corr`` raises in ANSI mode)."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
