"""The prefix trie against SQL and a trie built turn by turn; shards, copies, nulls and repeated rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from tapeline.llm import registry, trie
from tapeline.session import as_table

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "conv_id long, turn int, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def _brute(rows):
    members = {}
    found = _rebuilt(rows)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    own = {p: (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0 for p, m in members.items()}
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(found[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(spark, rows, shards=5, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: F.lit(3) for c in ("path", "words", "digest", "shard", "depth", "kind", "_h", "_base")})
    return sorted((tuple(r) for r in trie.prefix_trie(as_table(df.repartition(3), "t"), shards).collect()), key=str)


def _conversations(seed, n, copies):
    r = random.Random(seed)
    text = lambda: " ".join(r.choices(["a", "bb", "Ünï", "d\n"], k=r.randrange(0, 3)))
    rows = []
    for c in range(n):
        rows += [(c, t, r.choice(["user", "assistant", None]), text()) for t in range(r.randrange(1, 7))]
    rows += [(n + 20 * k + r.randrange(20), t, "user", f"copy {t}") for k in range(copies) for t in range(5)]
    return sorted(set(rows), key=lambda _: r.random())


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_turn_by_turn(spark, shards):
    rows = _conversations(3, 120, 150)
    assert _got(spark, rows, shards) == _brute(rows)


def test_long_lists_of_ends(spark, monkeypatch):
    """Copies end at one node, inside a shard and over many."""
    monkeypatch.setattr(trie, "IDS", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60) for t in range(4)] + [(c, 0, "user", f"{c % 3}") for c in range(60, 100)]
    for shards in (1, 9):
        assert _got(spark, rows, shards) == _brute(rows)


def test_skeleton_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(trie, "SKELETON", 64)
    rows = _conversations(4, 60, 30) + [(900 + c, t, "user", str(t)) for c in range(8) for t in range(40)]
    assert _got(spark, rows, 30) == _brute(rows)


def test_edges(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (2, 0, "user", None), (3, 1, "user", "x " * 30_000), (3, 1, "user", "x " * 30_000), (None, 0, "user", "lost"),
        (0, 0, "a", "bc"), (40, 0, "ab", "c"), (5, 2, "user", "late"), (5, 1, "user", "early"), (20, 0, "user", "only"),
        *[(k, 0, "user", "one turn") for k in range(21, 40)], *[(k, 0, "user", "no base") for k in range(61, 80)],
    ]
    want = _brute(rows)
    assert _got(spark, rows, extra=True) == want
    assert want[-1][1] == 0 or any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    assert _got(spark, []) == [] and _got(spark, [(None, 1, "a", "b")]) == []


def test_against_sql(spark):
    import oracle

    small = "/root/testdata/sf0.001"
    ok, text = oracle.compare(registry.QUERIES["op13_prefix_trie"].run(spark, small), oracle.connect(small), trie.SQL)
    assert ok, text


def test_common_prefixes():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([bytes([r.randrange(2)]) * trie.DIGEST for _ in range(r.randrange(9))] for _ in range(2))
        b = a[: r.randrange(9)] + b
        want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert trie._common(b"".join(a), b"".join(b)) == want
