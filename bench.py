"""Benchmark: median warm seconds per headline query; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (timed runs per query),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    # four stages on vectors
    "inner_product_scores", "topk_per_label", "threshold_bitmap", "paged_index", "paged_attention",
    "multi_head_topk", "table_lookup_topk", "latent_attention", "decode_budget", "decode_pages",
    # routing and feed-forward
    "gate_grouped", "expert_feed_forward", "expert_int8",
    # text
    "doc_freq", "inverted_index", "bm25_cpu", "bm25_multi_query", "rag_prompt", "sentences",
    # n-gram memory
    "ngram_hash", "ngram_lookup", "memory_residual",
    # sparse products, utilities
    "spmv_rows", "checksum", "latency_summary", "model_sizes",
]
BUILD = "text_index_build"  # tokenising, postings and vocabulary, which the text queries then share


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join([BUILD, *HEADLINE])).split(",")

    from sparkmoor.functions.staging import stage
    from sparkmoor.operators import bm25
    from sparkmoor.plans.catalog import REGISTRY
    from sparkmoor.session import get_spark
    from sparkmoor.sources.tables import spread_out, table

    spark = get_spark(f"local[{cpus}]", "bench", 8, "16g")

    def once(name: str) -> float:
        start = time.perf_counter()
        if name == BUILD:
            index = bm25.build_index(spread_out(table(spark, root, "documents").select("doc_id", "text")))
            stage(bm25.vocabulary(index.postings))
            return time.perf_counter() - start
        REGISTRY[name].run(spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, cold = {}, {}
    for name in names:
        cold[name] = round(once(name), 3)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name:28s} cold {cold[name]:7.3f}  warm {seconds[name]:7.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "cold": cold, "sf": Path(root).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
