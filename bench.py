"""Times the catalogue's queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from corpusprep.plans.catalog import QUERIES

HEADLINE = [
    "bm25_top10",
    "bm25_term_stats",
    "clean_corpus",
    "strip_accents",
    "tokenize",
    "whitespace_tokens",
    "encode_tokens",
    "encode_tokens_padded",
    "char_ngrams",
    "ratio_sample",
    "random_split",
    "stratified_sample",
    "fixed_batches",
    "sample_users",
    "match_triples_whole_text",
    "sample_accuracy",
    "running_means",
    "repair_deoverlap",
    "repair_strict",
    "count_type_value",
    "select_rare_values",
    "new_value_split",
    "bio_tags",
    "build_training_set",
    "build_training_set_new_value",
    "char_spans",
    "token_spans",
    "sliding_windows",
    "extract_series",
    "slice_sections",
    "align_runs",
    "locate_rows",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusprep-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every row and column and writes nothing.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
