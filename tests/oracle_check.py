"""Run queries and their SQL statements side by side and compare values.

Usage: python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v) if not isinstance(v, str) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if x is None else str(x) for x in t))


def kinds(columns, types):
    return {c: t for c, t in zip(columns, types)}


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN", "date": "DATE",
}


def compare(spark, con, name, build, sql, sf_dir):
    """Return (problem or None, rows, spark seconds)."""
    t0 = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return None, len(got), took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(set(cols) ^ set(df.columns))}", len(got), took
    for c, t in df.dtypes:
        if SPARK_TO_DUCK.get(t, t) != dtypes[c]:
            return f"type of {c}: {t} vs {dtypes[c]}", len(got), took
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(got), took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        names = sorted(df.columns)
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} rows differ, e.g. {diff[:4]}", len(got), took
    return None, len(got), took


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from ledgerlens.session import local_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = local_session(8)
    con = duck(sf)
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name in argv or qs:
        try:
            problem, n, took = compare(spark, con, name, qs[name], sqls.get(name), sf)
        except Exception as e:  # report and go on
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        tag = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{tag:5}{name:28}{n:8} rows {took:6.1f}s  {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
