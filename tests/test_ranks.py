"""Quantiles and ranks by passes, against numpy; large groups end in small buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.functions import ranks

PROBS = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q975": 0.975, "q100": 1.0}


@pytest.mark.parametrize(("buckets", "passes"), [(2, 1), (4, 3), (64, 2)])
def test_groups_of_any_shape(spark, buckets, passes):
    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(0, 3, 3000), "b": np.array([5.0]), "c": np.array([2.0] * 900 + [3.0]), "d": rng.integers(0, 5, 400) * 1.0, "e": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", PROBS, buckets, passes).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(x, p), rel=1e-12), (k, name)
    mean = {(r.k, r.v): r.rank for r in ranks.average_ranks(df, ["k"], "v", "rank", buckets, passes).collect()}
    for k, x in groups.items():
        for v in set(x[:50].tolist()):
            assert mean[(k, v)] == (x < v).sum() + ((x == v).sum() + 1) / 2


def test_no_bucket_of_a_large_group_is_large(spark):
    """Two million distinct values in one group: the rows that are ordered are a few thousandths."""
    n = 2_000_000
    df = spark.range(n).select(F.lit("x").alias("k"), (F.pow(F.col("id") / n, 3) * 1000).alias("v"))
    x = ranks._ties(df, ["k"], "v")
    own = ["k"]
    for p in range(ranks.PASSES):
        x = ranks._cut(x, own, "v", f"__b{p}", ranks.BUCKETS)
        own.append(f"__b{p}")
    assert x.groupBy(*own).count().agg(F.max("count")).first()[0] < n / 1000
    got = ranks.exact_quantiles(df, ["k"], "v", {"m": 0.5}).first().m
    assert got == pytest.approx(np.quantile((np.arange(n) / n) ** 3 * 1000, 0.5), rel=1e-12)
