"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and the order-insensitive multiset of rows.
"""
from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from opsledger.session import get_session  # noqa: E402
from opsledger.sources.tables import PROVIDED_TABLES  # noqa: E402
from opsledger.plans.registry import all_queries  # noqa: E402


def duck(sf_dir):
    con = duckdb.connect()
    for t in PROVIDED_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.spark(spark, sf_dir)
            srows = [tuple(canon(v) for v in r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:6s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.sql()
        if sql is None:
            print(f"{name:6s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = [tuple(canon(v) for v in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:6s} DUCKDB ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ok = scols == dcols and Counter(srows) == Counter(drows)
        status = "OK " if ok else "DIFF"
        print(f"{name:6s} {status} spark={len(srows)} duck={len(drows)} {ts:.1f}s")
        if not ok:
            bad += 1
            if scols != dcols:
                print("   cols", scols, dcols)
            a, b = Counter(srows), Counter(drows)
            print("   only spark:", list((a - b).elements())[:3])
            print("   only duck :", list((b - a).elements())[:3])
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
