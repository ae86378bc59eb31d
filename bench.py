"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from runledger.plans.catalog import QUERIES
from runledger.session import local_session

HEADLINE = [
    "build_runs", "list_runs", "timeline_index", "tool_durations", "timeline_gaps", "run_summary", "causal_depth",
    "event_type_counts", "arrival_disorder", "data_flow_edges", "graph_edges", "graph_summary", "critical_path",
    "redaction_audit", "validate_events", "normalize_openai_codex", "normalize_otel", "anomalies", "compliance_score",
    "build_search_index", "search_rank", "search_batch", "integrity_chain", "assemble_bundles",
    "layer_graph", "causal_chain", "redact_events", "stream_open_tools",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = wanted.split(",") if wanted else HEADLINE

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    run("event_type_counts")  # warm up the session
    times = {name: round(run(name), 3) for name in names}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
