"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Comparison mirrors the driver's: same row count, same column names, and the
same multiset of rows after sorting columns by name.  Floats are compared
after rounding to 9 significant digits.

CLI:  python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int,)):
        return (2, repr(v))
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return (3, "nan")
        if f == int(f) and abs(f) < 2**53:
            return (2, repr(int(f)))
        return (3, f"{f:.9g}")
    if isinstance(v, dt.datetime):
        return (4, v.isoformat())
    if isinstance(v, dt.date):
        return (4, v.isoformat())
    return (5, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str, con=None):
    from __spark_entry__ import oracle_sql, queries

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return dict(name=name, ok=None, spark_rows=len(s_rows), spark_s=t1 - t0)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    out = dict(name=name, spark_rows=len(s_rows), duck_rows=len(d_rows),
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sorted(sdf.columns) != sorted(d_cols):
        out.update(ok=False, why=f"columns {sorted(sdf.columns)} vs {sorted(d_cols)}")
        return out
    a, b = rows_of(sdf.columns, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out.update(ok=False, why=f"values differ; spark-only {diff_a} duck-only {diff_b}")
        return out
    out.update(ok=True)
    return out


def main(argv):
    from contentlens.session import build_session
    from __spark_entry__ import queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    spark = build_session("oracle-check", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=n, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
