"""Compare registered queries with their DuckDB text.

``python tests/oracle.py [name-part ...]`` prints one line per query."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TAPELINE_DATA", "/root/testdata/sf0.01")


def connect(d: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, (int, float)):
        return (1, float(f"{float(v):.6e}"))
    return (2, str(v))


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b and isinstance(a, bool) == isinstance(b, bool)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        if isinstance(a, int) != isinstance(b, int):
            return False
        if isinstance(a, float) and (math.isnan(a) or math.isnan(b)):
            return False
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    left = [tuple(r) for r in df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    right = [tuple(r[p] for p in pos) for r in cur.fetchall()]
    if len(left) != len(right):
        return False, f"rows {len(left)} vs {len(right)}"
    if not left:
        return True, "EMPTY"
    left.sort(key=lambda r: tuple(_key(v) for v in r))
    right.sort(key=lambda r: tuple(_key(v) for v in r))
    bad = 0
    first = ""
    for a, b in zip(left, right):
        for c, x, y in zip(cols, a, b):
            if not _same(x, y):
                bad += 1
                if not first:
                    first = f"{c}: {x!r} vs {y!r}"
    return bad == 0, f"{len(left)} rows" + (f", {bad} cells differ, first {first}" if bad else "")


def main(parts: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tapeline.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect()
    oracle = oracle_sql()
    failed = []
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, DATA)
            if name in oracle:
                ok, text = compare(df, con, oracle[name])
            else:
                rows = df.collect()
                ok, text = True, f"{len(rows)} rows (no SQL) {rows[0].asDict() if rows else 'EMPTY'}"
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - t0:6.2f}s  {text}", flush=True)
    print(f"failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
