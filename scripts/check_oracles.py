"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python scripts/check_oracles.py [--sf-dir DIR] [name ...]

Comparison: row count, sorted column names, and the multiset of rows (columns
sorted by name, floats rounded to 6 places, NaN as NULL).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        return round(f, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def duck(sf_dir):
    import duckdb

    from tabsmith.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir, verbose=False):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    info = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        info["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return info
    a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
    if len(a) != len(b):
        info["status"] = "ROWCOUNT"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info["status"] = f"VALUES e.g. {diff}"
    else:
        info["status"] = "ok"
    if verbose:
        info["spark_types"] = sdf.schema.simpleString()
        info["duck_types"] = [(d[0], str(d[1])) for d in res.description]
    return info


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("-v", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tabsmith.plans.registry import ORACLES, QUERIES, load_all
    from tabsmith.session import local_session

    load_all()
    spark = local_session(8, 8)
    con = duck(args.sf_dir)
    names = args.names or list(QUERIES)
    bad = 0
    for n in names:
        try:
            info = compare(spark, con, n, QUERIES[n], ORACLES.get(n), args.sf_dir, args.v)
        except Exception as exc:  # report and continue
            info = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if info["status"] not in ("ok", "rows-only"):
            bad += 1
        print(info, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
