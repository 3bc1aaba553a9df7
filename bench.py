"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all]

Each query is run to completion through the ``noop`` sink (full execution,
no driver collection), once cold and then warm; the warm time is reported.
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def run_once(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    run_all = "--all" in sys.argv

    from jobscope.plans.registry import BENCH, QUERIES, load_all
    from jobscope.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(int(cpus) * 2)})
    spark.sparkContext.setLogLevel("OFF")
    load_all()
    names = list(QUERIES) if run_all else list(BENCH)
    cold, warm = {}, {}
    for name in names:
        try:
            cold[name] = round(run_once(QUERIES[name](spark, sf_dir)), 3)
            warm[name] = round(run_once(QUERIES[name](spark, sf_dir)), 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            print(f"# {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_warm",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "spark": spark.version,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
