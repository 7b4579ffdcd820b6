"""Vector links against all pairs of a label; nulls, ties, repeated rows, hot labels and groups of copies."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import near_vectors
from tapeline.session import as_table

SCHEMA = "vec_id long, embedding array<double>, label int"


def _cosine(a, b):
    return float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b)))


def _brute(rows):
    """Links, smallest id reachable and kept of each row."""
    fits = [e is not None and len(e) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, label in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if fits[i] and fits[j] and a[2] == b[2] and len(a[1]) == len(b[1]) and _cosine(a[1], b[1]) >= near_vectors.COSINE:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[i]), low, r[0] == low))
    return sorted(out, key=str)


def _got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: F.lit(3) for c in ("row", "id", "v", "n", "at", "size", "root", "n_links")})
    return sorted((tuple(r) for r in near_vectors.near_duplicates(as_table(df, "t")).collect()), key=str)


def _around(rng, center, n, spread):
    return center + spread * rng.standard_normal((n, len(center)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vectors = [rng.standard_normal((150, 12))]
    # A hot label: one tight group, one chain of neighbours, one loose group, copies.
    chain = np.array([[math.cos(t), math.sin(t), *[0.0] * 10] for t in np.arange(0, 3, 0.17)])
    vectors += [_around(rng, rng.standard_normal(12), 120, 0.002), chain, _around(rng, rng.standard_normal(12), 80, 0.12), np.repeat(rng.standard_normal((1, 12)), 60, 0)]
    labels = [int(rng.integers(3)) for _ in range(150)] + [1] * (120 + len(chain) + 80 + 60)
    every = np.concatenate(vectors)
    ids = rng.permutation(len(every)).tolist()
    return [(i, v.tolist(), label) for i, v, label in zip(ids, every, labels, strict=True)]


@pytest.mark.parametrize(("block", "piece", "bits"), [(512, 128, 4), (8, 4, 1), (5, 64, 2)])
def test_all_pairs_of_a_label(spark, rows, monkeypatch, block, piece, bits):
    for name, value in (("BLOCK", block), ("PIECE", piece), ("FAN_BITS", bits)):
        monkeypatch.setattr(near_vectors, name, value)
    got = _got(spark, rows)
    assert got == _brute(rows)
    assert max(r[1] for r in got) >= 119


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (None, [3.0, 0.001], 1), (None, [0.0, 1.0], 1), (None, [0.0, 2.0], 2), (10, [1.0, 0.0, 0.0], 1),
        (11, [1e200, 0.0], 2), (12, [1e-200, 0.0], 2), (13, [-1.0, 0.0], 2), (14, [1.0, 0.0, 0.0], 1),
    ]
    assert _got(spark, rows, extra=True) == sorted(
        [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
        + [(None, 3, 1, False), (None, 0, None, True), (None, 0, None, True), (10, 1, 10, True), (14, 1, 10, False), (11, 1, 11, True), (12, 1, 11, False), (13, 0, 13, True)],
        key=str,
    )
    assert _got(spark, []) == []
    assert _got(spark, [(1, None, 1), (2, [0.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_single_precision_and_text_labels(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2], "a"), (2, [0.2, 0.4], "a"), (3, [0.1, 0.2], "b")], "vec_id int, embedding array<float>, label string")
    assert [tuple(r) for r in near_vectors.near_duplicates(as_table(df, "t")).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_a_dense_group_is_linked_as_a_whole(spark, monkeypatch):
    """No vectors are compared where balls lie close enough."""
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    monkeypatch.setattr(near_vectors, "join_intervals", None)
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(_around(rng, rng.standard_normal(6), 200, 0.001))]
    assert _got(spark, rows) == sorted([(k, 199, 0, k == 0) for k in range(200)], key=str)


def test_balls_and_boxes_never_lie():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (near_vectors.units(_around(rng, rng.standard_normal(5), 6, 10 ** rng.uniform(-3, 0))) for _ in range(2))
        if rng.random() < 0.5:
            y = near_vectors.units(_around(rng, x[0], 6, 10 ** rng.uniform(-3, -0.5)))
        sides = []
        for u in (x, y):
            p = near_vectors.project(u, {})
            center, radius = near_vectors._ball(u, np.zeros(6), np.ones(6))
            sides += [p.min(0)[None], p.max(0)[None], center[None], np.array([radius])]
        far, near = near_vectors.classify(*sides)
        linked = x @ y.T >= near_vectors.COSINE
        assert not (far[0] and linked.any()) and not (near[0] and not linked.all())
