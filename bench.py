"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402

HEADLINE = [
    "independent_t", "oneway_anova", "mannwhitney", "kruskal", "wilcoxon", "friedman", "descriptive", "frequency", "pearson", "spearman", "kendall",
    "correlation_matrix", "correlation_matrix_spearman", "chi_square", "multiple_regression", "robust_regression", "poisson_regression", "anderson_darling",
    "bootstrap_mean", "permutation_test", "moving_average", "arima", "exp_smoothing", "pca", "kaplan_meier", "logrank", "cox_ph", "concordance",
    "profile_columns", "quality_issues", "impute_interpolate", "winsorize", "histogram_bins", "box_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small pass starts the JVM's compilers and the Python workers before anything is timed.
    catalog.QUERIES["levene"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
