"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the local cores. Each query runs
once to warm up and then ``BENCH_RUNS`` times (default 2); the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from commentlens.plans.catalog import QUERIES
from commentlens.session import build_session

HEADLINE = (
    "normalise_text", "rule_label_counts", "rule_flag", "live_rule_flag", "url_classify", "token_counts",
    "subword_pieces", "thread_flatten", "insert_or_ignore", "update_by_key", "dedupe_author_text", "label_cap",
    "dataset_build", "author_queue", "author_preview", "cosine_pairs", "top_k_neighbours", "communities",
    "community_scores", "consensus_propagate", "eval_metrics", "policy_actions", "thread_cascade",
    "stream_dedupe", "stream_actions", "page_visible_text",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "commentlens-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = folder.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
