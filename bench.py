"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads;
BENCH_QUERIES may list query names (comma separated) or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "clean_and_summarise", "fill_mean", "fill_median", "fill_mode", "knn_impute", "dedup_remove", "dedup_overview",
    "dedup_first_by_key", "scale_standard", "scale_robust", "outlier_cap", "cap_upper", "text_standardize",
    "label_encode", "one_hot", "feature_ratio", "feature_bins", "feature_expression", "column_info_lineitem",
    "describe_numeric", "describe_categorical", "stats_numeric", "box_stats", "grouped_bar", "histogram",
    "histogram_2d", "line_grouped", "group_histogram", "contingency", "density_2d", "poly_fit_parabola", "robust_fit",
    "lowess", "corr_pearson", "corr_spearman", "corr_kendall", "ab_event_metrics", "ab_core", "dwell", "sessions",
    "stream_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from pyspark.sql import SparkSession

    from sievework.catalog import all_queries
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.openCostInBytes", str(1 << 20))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if asked == "all" else asked.split(",") if asked else HEADLINE
    # Start the JVM's and the Python workers' machinery before the clock runs.
    known["clean_and_summarise"](spark, folder).collect()
    spark.range(8).mapInPandas(lambda batches: batches, "id long").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
