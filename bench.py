"""Time the registered queries: prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the median counts (default 1)
BENCH_QUERIES  comma-separated names (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import queries  # noqa: E402
from lakeimpact.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = local_session("bench", cores)

    def once(query, sf) -> float:
        began = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    chosen = {n: q for n, q in queries().items() if not names or n in names}
    # Start the JVM's compilers and the Python workers on something small.
    for warm in ("gold_daily_revenue", "python_table_refs"):
        once(queries()[warm], folder)
    seconds = {}
    for name, query in chosen.items():
        seconds[name] = round(statistics.median(once(query, folder) for _ in range(runs)), 3)
        print(f"{name:26} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
