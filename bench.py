"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from likeness.plans.queries import QUERIES  # noqa: E402
from likeness.session import build_session  # noqa: E402

HEADLINES = [
    "token_counts",
    "doc_features",
    "kind_ngrams_4",
    "case_pairs",
    "negative_pairs",
    "token_overlap",
    "sequence_measures",
    "batch_pairs",
    "case_near_copies",
    "candidate_pairs",
    "overlap_snippets",
    "cosine_similarity",
    "stratified_split",
    "binary_metrics",
    "auc_rank",
    "weight_accuracy",
    "batch_report",
    "doc_embedding",
    "logistic_regression",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/labels.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.mode("overwrite").format("noop").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
