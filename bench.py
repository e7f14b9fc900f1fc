"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Session settings are sized from the input (``session.sized_conf``).  The
load step (``Book.load``: layouts, snapshots and hot-key lists) runs once first and is timed as ``prepare``.
Each query runs to completion through the ``noop`` sink (the whole plan
executes; nothing is collected to the driver).  Each query runs ``BENCH_RUNS`` times (default 3);
the best time is reported.  The JVM collects garbage between runs,
outside the timed region, so one query's garbage is not billed to the
next.  Prints one JSON line: the queries' sum (``value``), the load step
(``prepare_sec``) and both together (``whole_job_sec``).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskbook.registry import QUERIES, book_for, input_paths  # noqa: E402
from riskbook.session import build_session, input_bytes, sized_conf  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        master=f"local[{cpus}]", app="riskbook-bench",
        extra={"spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskbook-bench-")},
    )
    for key, value in sized_conf(input_bytes(spark, input_paths(sf_dir)), cpus).items():
        spark.conf.set(key, value)
    jvm_gc = spark.sparkContext._jvm.java.lang.System.gc
    spark.range(1).count()  # JVM warm-up, not timed

    t0 = time.perf_counter()
    book = book_for(spark, sf_dir).load()
    prepare = time.perf_counter() - t0

    times: dict[str, float] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        best = float("inf")
        for _ in range(runs):
            jvm_gc()
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        times[name] = round(best, 4)

    total = sum(times.values())
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": times,
        "prepare_sec": round(prepare, 3),
        "whole_job_sec": round(total + prepare, 3),
        "runs": runs,
        "stat": "min",
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    book.close()
    spark.stop()


if __name__ == "__main__":
    main()
