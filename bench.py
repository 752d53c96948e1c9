"""Times headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1)   BENCH_CPUS (default 8)
    BENCH_QUERIES (comma-separated names, or ``all``)

Each query is run once to warm up and then three times into a sink that keeps
nothing; its time is the median of the three.  ``value`` is the sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "hourly_rollup counts_by_kind top_words_hour daily_totals busiest_quietest_hour verify_totals event_ids_sha1 "
    "segment_join insert_or_ignore window_dedupe captions retime gate_runs bursts novelty trailing_buffer nearest_frame "
    "topk_detections iou_pairs tracks cooldown rolling_baseline near_dup_captions"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from eventide.queries import registry
    from eventide.session import build

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        f"local[{cpus}]", "bench", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(3)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf)).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
