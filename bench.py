"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (default 3); the median counts. The
result is fully computed into the noop sink. ``BENCH_QUERIES`` (comma separated, or ``all``) picks
other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from reviewframe.session import local_session  # noqa: E402
from reviewframe.workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "parse_hunks", "hunks_nested", "diff_stats", "split_multifile_diff", "changed_files",
    "reviewable_files", "findings_parse", "dedup_comments", "noise_control", "review_summary",
    "ground_comments", "suppress_repeats", "feedback_stats", "patch_bundle", "audit_stats",
    "audit_query", "review_runs", "signature_verify", "delivery_outcome", "rate_limit",
    "rate_limit_one_key", "extract_nodes", "modified_nodes", "blast_radius", "knn", "knn_by_repo",
    "embed_chunks", "build_index", "rule_scan", "review_findings", "review_overview",
    "blast_context_per_review", "review_inputs_composed", "review_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    picked = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if not picked else list(QUERIES) if picked == "all" else picked.split(",")
    spark = local_session(cpus, "bench", memory=os.environ.get("BENCH_MEMORY", "12g"))
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
