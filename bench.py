"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query runs once
to warm up, then BENCH_RUNS times; the median counts. Results go to Spark's
no-op sink, so all rows and columns are computed and none are fetched.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordloom.session import local_session  # noqa: E402
from recordloom.workload import QUERIES  # noqa: E402

HEADLINE = [
    "equality_filter",
    "regex_full",
    "regex_simple_prefix",
    "regex_across_lines",
    "page",
    "page_envelope",
    "sorted_page",
    "row_count",
    "max_lengths",
    "all_column_names",
    "ingest_lineitem",
    "ingest_ragged",
    "ingest_multiline",
    "ingest_and_query",
    "lookup_layout_query",
    "export_json",
    "export_csv_roundtrip",
    "alias_resolve",
    "alias_set",
    "hash_scalars",
    "query_string_params",
    "trailing_request_count",
    "retry_after",
    "retry_after_hot_keys",
    "sliding_admission",
    "average_admission",
    "stream_sliding_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
