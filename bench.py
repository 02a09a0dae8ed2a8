"""Benchmark: wall time of the registered queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list; default all). Each query runs once warm: its plan
is executed to completion with the ``noop`` sink (no rows to the driver).
``publish`` times the whole build (plans of both catalog states, topic
records of both runs, search index) that the other queries read. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from docscope.plans import corpus as C
    from docscope.plans.queries import QUERIES
    from docscope.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    # warm session: JIT, code generation and Python workers on the smallest
    # data set, so timings below are steady-state per query
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and warm.rstrip("/") != sf_dir:
        C.publish_all(spark, warm)
        for fn in QUERIES.values():
            fn(spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    t0 = time.time()
    C.publish_all(spark, sf_dir)
    times["publish"] = round(time.time() - t0, 3)
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
