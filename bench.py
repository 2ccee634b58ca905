"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up (code generation, Python workers) and is then timed with a noop
sink, so that the whole result is computed and nothing is collected."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from provloom.plans import catalogue
from provloom.session import get_spark

HEADLINE = (
    "subgraph_summary component_sizes parallel_edge_rule node_numbering gap_sessions cascade_merges flow_reduced_edges "
    "similar_file_representatives reduction_summary labelled_segments filtered_attack_segments tactic_window_any_end "
    "lifted_paths node_labels labelled_sentences alternating_pairs_dropped near_duplicate_sentences attack_sentences "
    "best_object_phrase abstracted_reports nearest_references label_ranking_average_precision two_stage_retrieval "
    "log_event_edges kernel_event_edges audit_events audit_graph_edges tactic_templates"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_spark("provloom-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in wanted:
        fn = catalogue.QUERIES[name]
        best = None
        for _ in range(2):
            t = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            best = time.perf_counter() - t
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
