"""Benchmark of the headline queries.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "sentence_split", "token_df", "bm25_topk", "bm25_max_expansion", "tfidf_topk", "dense_topk", "contains_join", "rrf_fusion",
    "rule_delta_rerank", "sentence_facts", "graph_nodes_edges", "graph_search", "edge_merge_list", "graph_ego", "intent_route",
    "risk_level", "outcome_route", "hit_mrr", "upper_median", "stratified_split", "exact_dedupe", "near_dedupe", "html_lines",
    "rate_limit_exact", "hybrid_retrieve",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    from clausegraph.registry import QUERIES
    from clausegraph.session import build_session

    spark = build_session(f"local[{cpus}]", "bench", **{"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "20g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
