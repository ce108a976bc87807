"""Time the oracle SQL of the headline queries in DuckDB (single node, for context)."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from bench import HEADLINE  # noqa: E402
from opsledger.plans.registry import all_queries  # noqa: E402
from opsledger.sources.tables import PROVIDED_TABLES  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    threads = int(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    for t in PROVIDED_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = {}
    for name in HEADLINE:
        sql = all_queries()[name].sql()
        con.execute(sql).fetchall()
        samples = []
        for _ in range(3):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            samples.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(samples), 3)
    print(json.dumps({"engine": "duckdb", "threads": threads, "queries": out, "total": round(sum(out.values()), 3)}))


if __name__ == "__main__":
    main()
