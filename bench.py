"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quality_score_lineitem",
    "column_analysis_gaps",
    "numeric_stats_lineitem",
    "outliers_lineitem",
    "correlation_matrix_lineitem",
    "full_report_gaps",
    "impute_median",
    "forward_fill_by_event",
    "remove_duplicates_first",
    "cap_outliers",
    "bin_equal_frequency",
    "rolling_stats",
    "label_encode",
    "welch_t_test",
    "mann_whitney_u",
    "chi_square_brand_type",
    "linear_regression_revenue",
    "anova_price_by_priority",
    "spearman_test",
    "kendall_test",
    "decompose_additive_weekly",
    "cohort_monthly_orders",
    "histogram_order_price",
    "kde_account_balance",
    "pareto_customer_revenue",
    "trend_monthly_revenue",
    "grouped_box_priority",
    "sql_aggregate",
    "sql_window",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tabulon.shipping import ship
    from workload import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    ship(spark, os.path.join(os.path.dirname(os.path.abspath(__file__)), "workload"))
    for name in ("sql_aggregate", "kde_account_balance"):  # JVM and Python worker start-up is not measured
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
