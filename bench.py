"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from sevfold.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = """
flagship_metrics_by_lang a14_metrics_row f1_clean_code f5_f11_all_scopes f13_render_prompt f18_code_tokens
a3_length_profile a15_vocabulary m1_bow_counts m2_desc_features_config2 m3_subword_features
t1_group_split_customers w8_stratified_fractions w9_assign_folds j1_overwrite_from w1_best_per_group w2_best_params
w5_early_stop_consecutive f32_parse_log a17_mann_whitney a18_wilcoxon a20_cvss_distance
j8_knn_l2 m6_mean_vector f29_extract_fields f17_stem_tokens m3_subword_vectors m8_naive_bayes m11_random_forest
""".split()


def prepared(spark: SparkSession, folder: str) -> str:
    """The tables with ``documents`` in one file per core: the given one is a single row group, that is one task."""
    for name in os.listdir(SF_DIR):
        if name != "documents.parquet":
            os.symlink(os.path.join(SF_DIR, name), os.path.join(folder, name))
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(int(CPUS)).write.parquet(f"{folder}/documents.parquet")
    return folder


def main(names: list[str]) -> None:
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    os.mkdir(f"{scratch}/tables")
    tables = prepared(spark, f"{scratch}/tables")
    QUERIES["flagship_metrics_by_lang"](spark, tables).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
