"""Vector codes against SQL, plain Lloyd rounds in Python integers, and trees against their definition."""

from __future__ import annotations

import hashlib
import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import codes, registry
from tapeline.session import as_table

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows):
    kept = [(i, e, label) for i, e, label in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[max(-codes.LARGEST, min(codes.LARGEST, math.floor(x * 256))) for x in e] for _, e, _ in kept]
    width = -(-len(whole[0]) // 16)
    whole = [w + [0] * (16 * width - len(w)) for w in whole]
    part = lambda w, p: w[p * width : (p + 1) * width]
    books = [[part(w, p) for w in whole[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda k: (far(v, books[p][k]), k))
    for _ in range(2):
        for p in range(16):
            groups = {}
            for w in whole:
                groups.setdefault(nearest(p, part(w, p)), []).append(part(w, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else b for k, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), w in zip(kept, whole, strict=True):
        ks = [nearest(p, part(w, p)) for p in range(16)]
        error = sum(far(part(w, p), books[p][k]) for p, k in enumerate(ks))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for k in ks), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def _got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: F.lit(3) for c in ("id", "v", "row", "code", "error", "slot", "label_error", "points")})
    return sorted((tuple(r) for r in codes.compress(as_table(df.repartition(3), "t")).collect()), key=str)


def _rows(n, size, seed, step=0.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size)).astype(np.float32) * 0.4
    if step:
        x = np.round(x / step) * step
    return [(int(i), [float(a) for a in v], [None, 0, 1, 2][i % 4]) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize(("n", "size", "step"), [(300, 32, 0.0), (300, 16, 0.25), (40, 48, 0.0), (90, 19, 0.5)])
def test_lloyd_rounds(spark, monkeypatch, n, size, step):
    monkeypatch.setattr(codes, "BLOCK", 64)
    monkeypatch.setattr(codes, "LEAF", 4)
    rows = _rows(n, size, n + size, step)
    assert _got(spark, rows) == _brute(rows)


def test_edges(spark):
    good = _rows(70, 16, 1)
    rows = good + good[:3] + [(None, good[5][1], None), (200, None, 1), (201, [], 1), (202, [None, *good[0][1][1:]], 1), (203, [float("nan"), *good[0][1][1:]], 1)]
    rows += [(204, good[0][1][:8], 1), (205, [float("inf"), *good[0][1][1:]], 1), (206, [3e38, *good[0][1][1:]], 1), (207, [-3e38, *good[0][1][1:]], 1)]
    assert _got(spark, rows, extra=True) == _brute(rows)
    assert _got(spark, []) == [] and _got(spark, [(1, None, 1)]) == []
    assert _got(spark, [(7, [0.5] * 16, None)]) == _brute([(7, [0.5] * 16, None)])


def test_against_sql(spark):
    import oracle

    small = "/root/testdata/sf0.001"
    ok, text = oracle.compare(registry.QUERIES["op12_vector_codes"].run(spark, small), oracle.connect(small), codes.SQL)
    assert ok, text


def test_trees_are_cover_trees():
    points = np.random.default_rng(4).integers(-200, 200, (700, 3))
    t = codes.cover_tree(points)
    assert sorted(t["order"].tolist()) == list(range(700))
    inner = 0
    for k in range(len(t["first"])):
        own = points[t["order"][t["first"][k] : t["last"][k]]]
        away = np.sqrt(((own - t["center"][k]) ** 2).sum(1))
        assert t["radius"][k] == pytest.approx(away.max()) and (t["sums"][k] == own.sum(0)).all()
        if t["children"][k]:
            inner += 1
            c = slice(t["child"][k], t["child"][k] + t["children"][k])
            assert t["first"][c][0] == t["first"][k] and t["last"][c][-1] == t["last"][k] and (t["first"][c][1:] == t["last"][c][:-1]).all()
            assert (t["radius"][c] <= t["radius"][k] / 2).all() and (t["center"][c][0] == t["center"][k]).all()
            gaps = np.sqrt(((t["center"][c][:, None] - t["center"][c][None]) ** 2).sum(2))
            assert (gaps[~np.eye(t["children"][k], dtype=bool)] > t["radius"][k] / 2).all()
    assert inner > 10


def test_whole_subtrees_are_assigned():
    """Far groups: no single point is compared."""
    rng = np.random.default_rng(6)
    centers = np.array([[0, 0], [5000, 0], [0, 5000], [9000, 9000]])
    points = np.repeat(centers, 500, 0) + rng.integers(-20, 20, (2000, 2))
    tree = codes.forest(points, 1)
    entries, added, compared = codes.assign(tree, points, centers[None])
    assert compared == 0 and entries.tolist() == np.repeat(np.arange(4), 500).tolist()
    assert sum(int(n.sum()) for _, _, n, _ in added) == 2000
