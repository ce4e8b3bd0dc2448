"""Run registered queries beside their checking SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        return f"DEC{v}"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


KIND = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
        "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, name, fn, sql, folder):
    """Return (problem or None, rows, spark seconds, duckdb seconds)."""
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    a, an = rows_of(df.columns, got)
    b, bn = rows_of(names, want)
    problem = None
    if an != bn:
        problem = f"columns {an} != {bn}"
    elif len(a) != len(b):
        problem = f"rows {len(a)} != {len(b)}; only spark {[x for x in a if x not in set(b)][:2]}, only sql {[x for x in b if x not in set(a)][:2]}"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        only_a = sorted(set(a) - set(b))[:2]
        only_b = sorted(set(b) - set(a))[:2]
        problem = f"{len(diff)} of {len(a)} rows differ, columns {an}\n   spark {only_a}\n   sql   {only_b}"
    else:
        wrong = {c: (t, types[c]) for c, t in df.dtypes if KIND.get(t) != types[c]}
        if wrong:
            problem = f"types {wrong}"
    return problem, len(a), t1 - t0, t2 - t1


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tickerloom import session
    from tickerloom.catalog import load

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session.local_session(8)
    con = connect(folder)
    q, o = load()
    picked = [n for n in q if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in picked:
        try:
            problem, rows, ts, tq = compare(spark, con, n, q[n], o.get(n), folder)
        except Exception as e:  # noqa: BLE001
            problem, rows, ts, tq = f"{type(e).__name__}: {str(e)[:700]}", 0, 0, 0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {n:28s} rows={rows:7d} spark={ts:6.2f}s sql={tq:6.2f}s {'' if n in o else '(no sql)'} {problem or ''}"
              + ("  EMPTY" if rows == 0 and problem is None else ""), flush=True)
    print(f"{len(picked) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
