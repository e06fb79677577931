"""Time the headline queries and print one JSON line.

Each query runs once untimed, to load and compile its code, and is then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from glossa.plans.catalog import QUERIES
from glossa.plans.registry import SPREAD
from glossa.session import local_session

HEADLINE = [
    "concept_rank",
    "conformity",
    "prototypes",
    "amplification",
    "critical_tiers",
    "zipf",
    "sense_counts",
    "cooccur",
    "concept_docs",
    "classify_passages",
    "readability",
    "item_ids",
    "control_search",
    "pending_work",
    "accuracy_summary",
    "vs_baseline",
    "glm_cells",
    "mean_of_means",
    "effort_ratio",
    "box_summary",
    "fleiss",
    "icc21",
    "preset_entropy",
    "spearman",
    "factorial_ols",
    "aic_compare",
    "partial_corr",
    "lmm",
    "silhouette_delta",
    "sil_stability",
    "tfidf_silhouette",
    "paragraphs",
    "jsonl_roundtrip",
    "call_monitor",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    # The test tables are files of one row group; dealing them out is part of the time.
    spark = local_session(cores, cores, **{SPREAD: str(cores)})
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time of the second run",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
