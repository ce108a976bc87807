"""Benchmark the headline queries.

Runs each headline query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line. Every query is fully
executed into the ``noop`` sink (no driver collect); the reported time is the
median of ``$BENCH_REPS`` (default 3) warm runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opsledger.plans.registry import all_queries  # noqa: E402
from opsledger.session import get_session  # noqa: E402

HEADLINE = ["M22", "X5", "M20", "S5", "D1", "D2", "D3", "D5", "J2_day", "J4", "Q1", "Q2", "I4", "I5", "C4"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus * 2)))
    spark = get_session(f"local[{cpus}]", app="opsledger-bench", shuffle_partitions=partitions,
                        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    registry = all_queries()
    names = only or HEADLINE
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        q = registry[name]
        q.spark(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            q.spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = q.spark(spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows, "sf": sf, "cpus": cpus,
                      "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
