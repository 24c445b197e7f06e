"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name-substring ...]

Compares row count, column names and an order-insensitive multiset of rows
(floats compared after rounding to 6 decimals; exact float equality is
reported separately as ``exact``).
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

from ebbflow.plans import load_all  # noqa: E402
from ebbflow.session import get_session  # noqa: E402
from ebbflow.sources.tables import TABLES  # noqa: E402


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item") and not isinstance(v, (list, dict, str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if digits is None:
            return repr(v)
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v) if digits is not None else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return str(v)


def _rows(cols, tuples, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(t[i], digits) for i in order) for t in tuples]
    return sorted(out, key=repr)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    reg = load_all()
    spark = get_session("oracle-check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = skipped = 0
    for name, (fn, sql) in sorted(reg.items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if sql is None:
            print(f"rows  {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            skipped += 1
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL  {name}: columns spark={sorted(scols)} duckdb={sorted(dcols)}")
            bad += 1
            continue
        a = _rows(scols, srows, 6)
        b = _rows(dcols, drows, 6)
        if len(a) != len(b) or a != b:
            print(f"FAIL  {name}: rows spark={len(a)} duckdb={len(b)}")
            sa, sb = set(a), set(b)
            diff_a = [r for r in a if r not in sb][:3]
            diff_b = [r for r in b if r not in sa][:3]
            print("   spark-only:", diff_a)
            print("   duckdb-only:", diff_b)
            print("   cols:", sorted(scols))
            bad += 1
            continue
        exact = _rows(scols, srows, None) == _rows(dcols, drows, None)
        print(f"ok    {name}: {len(a)} rows ({ts:.1f}s){'' if exact else ' [float-ulp]'}")
        ok += 1
    print(f"== ok {ok}  fail {bad}  rows-only {skipped}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
