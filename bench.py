"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores. Each query is
run once to warm up and then three times; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from queries import all_queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = {
    "heatwave_events": "h10_event_rates",
    "label_subdaily": "h14_label_subdaily",
    "tumbling_summary": "d01_summarise",
    "interval_label": "c06_interval_label",
    "nearest_asof": "c08_nearest_asof",
    "range_join_rollup": "c07_range_join",
    "time_to_settle": "c09_time_to_settle",
    "rolling": "e06_rolling",
    "cumsum_phase": "e03_cumsum_phase",
    "pid_replay": "e19_pid_replay",
    "hysteresis_replay": "e20_hysteresis_replay",
    "quantiles": "d08_quantiles",
    "unpivot": "d13_to_long",
    "acf": "i09_acf",
    "ols": "i02_ols",
    "p_adjust_bh": "e16_p_adjust_bh",
    "shift_to_baseline": "e17_shift_to_baseline",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    seconds = {}
    for label, name in HEADLINE.items():
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[label] = round(statistics.median(took[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
