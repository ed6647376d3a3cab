"""Prints one JSON line: the median seconds of warm runs of the headline queries, their sum, and the seconds of each first run, which builds what the engine keeps."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = ("bm25_topk", "hybrid_balanced", "hybrid_aggressive", "feat_bm25_fields", "feat_overlap_desc", "typo_correct", "knn_cosine", "term_idf", "bigram_freq", "corpus_build", "profile_summary", "search_e2e")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: The whole search is measured once, beside its first run, which fits its models.
FEWER = {"search_e2e": 1}


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.plans.registry import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + min(RUNS, FEWER.get(name, RUNS))):  # the first compiles, and builds what the engine keeps
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name], first[name] = round(median(runs[1:]), 3), round(runs[0], 3)
    spark.stop()
    print(json.dumps({"metric": "search_engine_warm_median", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "first_runs": first, "sf": Path(folder).name, "cores": int(cpus), "runs": RUNS}))


if __name__ == "__main__":
    main()
