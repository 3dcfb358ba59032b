"""Run queries with Spark and their oracle SQL with DuckDB; compare like the driver does.

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from postmetrics.session import build_session  # noqa: E402
from postmetrics.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, key, qfn, sql, sf_dir):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(key=key, status="rows-only", rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    ok_cols = sorted(s_cols) == sorted(d_cols)
    if ok_cols:
        si = [s_cols.index(c) for c in sorted(s_cols)]
        di = [d_cols.index(c) for c in sorted(d_cols)]
        sv = sorted((tuple(r[i] for i in si) for r in s_rows), key=repr)
        dv = sorted((tuple(r[i] for i in di) for r in d_rows), key=repr)
        ok_vals = sv == dv
    else:
        ok_vals = False
        sv = dv = []
    out = dict(key=key, status="ok" if (ok_cols and ok_vals) else "MISMATCH", rows=len(s_rows),
               oracle_rows=len(d_rows), spark_s=round(t1 - t0, 2))
    if not ok_cols:
        out["cols"] = (s_cols, d_cols)
    elif not ok_vals:
        other_d, other_s = set(dv), set(sv)
        diff_s = [r for r in sv if r not in other_d][:3]
        diff_d = [r for r in dv if r not in other_s][:3]
        out["diff"] = (diff_s, diff_d)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for k in (keys or sorted(qs)):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as e:  # report and continue
            r = dict(key=k, status="ERROR", err=repr(e)[:600])
        if r["status"] in ("MISMATCH", "ERROR"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(keys or qs)} keys, {bad} bad")


if __name__ == "__main__":
    main()
