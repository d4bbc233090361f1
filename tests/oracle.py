"""Compare a registered query with its SQL twin in DuckDB."""

import datetime as dt
import glob
import math
import os
import time

import duckdb

TIMES = []


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        if math.isfinite(f):
            return f"{f + 0.0:.6g}" if abs(f) < 1e6 else f"{f:.10g}"
        return str(f)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, fn, sql, sf_dir):
    """Returns None when equal, else a description of the difference."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    mid = time.time()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    TIMES.append((mid - start, time.time() - mid, len(want)))
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}"
    return None
