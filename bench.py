"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion (all result rows fetched); the time per query is wall-clock seconds
of the second run (the first run warms the JVM and code caches and is not counted).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans import catalog  # noqa: E402
from ledgerloom.session import get_session  # noqa: E402

HEADLINE = [
    "latest_published", "versions", "contracts_enriched", "audit_dropped", "search_published",
    "decode_publish", "wasm_detail", "deploy_detail", "list_contracts", "page_export", "similarity_join",
    "g_latest_per_key", "g_similarity_join", "g_anti_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = get_session(f"local[{cpus}]", app="ledgerloom-bench", shuffle_partitions=cpus * 2,
                        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    times, rows = {}, {}
    for name in names:
        fn = catalog.REGISTRY[name][0]
        best = None
        for attempt in range(2):
            t0 = time.perf_counter()
            n = len(fn(spark, sf_dir).collect())
            dt = time.perf_counter() - t0
            if attempt == 1 or best is None:
                best = dt
            rows[name] = n
        times[name] = round(best, 3)
        print(f"# {name}: {times[name]}s rows={rows[name]}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "rows": rows, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
