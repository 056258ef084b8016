"""Time the headline queries on local cores and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Every query runs to the
end into Spark's no-op sink, once cold and then warm; the reported time is the warm one.
"""

import json
import os
import sys
import time

from corpuscle.plans.session import local_session
from corpuscle.registry import all_queries

HEADLINE = (
    "hybrid_retrieve",
    "symbol_search",
    "fts_and",
    "fts_or",
    "vector_topk",
    "vector_topk_approx",
    "chunk_files",
    "weighted_windows",
    "line_windows",
    "markdown_sections",
    "class_skeletons",
    "python_symbols",
    "split_identifiers",
    "build_postings",
    "pending_embeddings",
    "token_batches",
    "embed_documents",
    "index_stats",
    "sweep_snapshots",
    "snapshot_diff",
    "expand_top",
    "resolve_citations",
    "answer_stats",
    "latency_stages",
    "eval_report",
)


def run(query, spark, sf: str) -> float:
    """Seconds for one full run of a query."""
    started = time.monotonic()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.monotonic() - started


def main() -> None:
    """Time each query cold and warm."""
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, name="bench")
    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for name in wanted:
        cold[name] = round(run(queries[name], spark, sf), 3)
        warm[name] = round(run(queries[name], spark, sf), 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cores),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
