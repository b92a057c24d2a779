"""Time every registered query on one scale factor and print one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma list.
Results go to a no-op sink, so every row is computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.catalogue import QUERIES  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ledgerloom-bench")
    # the first query of a JVM pays for class loading, not for its plan
    QUERIES["financial_summary"](spark, folder).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for name in wanted:
        started = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
            continue
        times[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
