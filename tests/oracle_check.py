"""Local twin of the driver's compare: run queries() and oracle_sql() side by side.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.md5(repr(tuple(norm(r[i]) for i in order)).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(hs).encode()).hexdigest()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from sitelake.session import local_session
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sqls = queries(), oracle_sql()
    ok = True
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        dt = time.time() - t0
        if name not in sqls:
            print(f"{name:24s} rows={len(rows):7d} spark={dt:6.2f}s  (no oracle)")
            continue
        rel = con.sql(sqls[name])
        ocols = rel.columns
        orows = rel.fetchall()
        same_cols = sorted(cols) == sorted(ocols)
        match = same_cols and len(rows) == len(orows) and digest(cols, rows) == digest(ocols, orows)
        ok &= match
        print(f"{name:24s} rows={len(rows):7d}/{len(orows):7d} cols={'ok' if same_cols else 'DIFF'} "
              f"hash={'MATCH' if match else 'MISMATCH'} spark={dt:6.2f}s")
        if not same_cols:
            print("   spark:", cols, "\n   oracle:", ocols)
        elif not match:
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
            a = {tuple(norm(r[i]) for i in order) for r in rows}
            b = {tuple(norm(r[i]) for i in oorder) for r in orows}
            print("   only spark:", list(a - b)[:2])
            print("   only oracle:", list(b - a)[:2])
    spark.stop()
    sys.exit(0 if ok else 1)


if __name__ == "__main__":
    main()
