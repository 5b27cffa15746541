"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a2_dataset_overview", "a4_describe_all", "a12_box_summary", "a14_pearson_pairs", "a15_spearman_pairs", "a16_kendall_pairs",
    "c5_detect_outliers_iqr", "c11_scale_robust", "c14_auto_preprocess", "e4_select_top_charts", "j1_merge_inner_chain",
    "w1_remove_duplicates_first", "m1_stratified_split", "k1a_lloyd_step", "g1_linear",
    "n9_sequential_cleaning", "n13_ngram_freq_2", "n15_kwic", "n19_tfidf", "n20_transform_fitted",
    "j8_knn_join", "k3_silhouette_score", "k4_dbscan", "xm4_flatten_records", "xm10_drop_empty", "im5_glcm", "im12_sobel",
]


def main() -> None:
    from queries import load_all
    from tabloom.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # JVM and file system warm-up
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
