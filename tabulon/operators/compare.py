"""Side-by-side comparison of two tables, the combined report and its history."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulon.errors import AnalysisError
from tabulon.operators.profile import TableProfile, column_analysis, profiled
from tabulon.operators.quality import quality_breakdown, quality_score, recommendations
from tabulon.operators.rows import preview
from tabulon.operators.types import detect_boolean, detect_categorical, detect_datetime, detect_numeric_strings
from tabulon.plans.results import result_frame


@dataclass
class Report:
    """The six report parts and a preview, each a DataFrame."""

    basic_info: DataFrame
    column_analysis: DataFrame
    top_values: DataFrame
    correlation_matrix: DataFrame
    outliers: DataFrame
    quality_score: DataFrame
    quality_breakdown: DataFrame
    recommendations: DataFrame
    datetime_suggestions: DataFrame
    categorical_suggestions: DataFrame
    numeric_suggestions: DataFrame
    boolean_suggestions: DataFrame
    preview: DataFrame

    def to_dict(self) -> dict:
        """Plain Python form; every part is bounded by columns or by the preview size."""
        def rows(frame: DataFrame) -> list[dict]:
            return [r.asDict(recursive=True) for r in frame.collect()]

        return {
            "basic_info": rows(self.basic_info)[0],
            "column_analysis": rows(self.column_analysis),
            "top_values": rows(self.top_values),
            "correlation_matrix": rows(self.correlation_matrix),
            "outliers": rows(self.outliers),
            "quality_score": {
                **rows(self.quality_score)[0],
                "breakdown": rows(self.quality_breakdown),
                "recommendations": [r["message"] for r in rows(self.recommendations)],
            },
            "type_suggestions": {
                "datetime_suggestions": rows(self.datetime_suggestions),
                "categorical_suggestions": rows(self.categorical_suggestions),
                "numeric_suggestions": rows(self.numeric_suggestions),
                "boolean_suggestions": rows(self.boolean_suggestions),
            },
            "preview": rows(self.preview),
        }


def full_report(table, order_by: list[str] | None = None) -> Report:
    with profiled(table, order_by=order_by) as p:
        return _report(p)


def _report(p: TableProfile) -> Report:
    p.load("outlier_rows", "duplicates", "distinct")
    return Report(
        basic_info=p.basic_info(),
        column_analysis=p.column_analysis(),
        top_values=p.top_values(),
        correlation_matrix=p.correlation_matrix(),
        outliers=p.outliers(),
        quality_score=quality_score(p),
        quality_breakdown=quality_breakdown(p),
        recommendations=recommendations(p),
        datetime_suggestions=detect_datetime(p),
        categorical_suggestions=detect_categorical(p),
        numeric_suggestions=detect_numeric_strings(p),
        boolean_suggestions=detect_boolean(p),
        preview=preview(p.df, order_by=p.order_by),
    )


def schema_diff(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """One row: column names on one side only, common names, row and column differences."""
    left, right = set(df1.columns), set(df2.columns)
    row = (
        sorted(left - right),
        sorted(right - left),
        sorted(left & right),
        df1.count() - df2.count(),
        len(df1.columns) - len(df2.columns),
    )
    return result_frame(
        df1.sparkSession,
        [row],
        "first_only array<string>, second_only array<string>, common array<string>, "
        "row_count_diff long, column_count_diff long",
    )


def compare(table1, table2) -> DataFrame:
    """Column analyses of two tables joined by column name."""
    first, second = column_analysis(table1), column_analysis(table2)
    keep = ["dtype", "missing_count", "unique_count", "mean", "std"]

    def side(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select("name", *[F.col(k).alias(f"{k}_{tag}") for k in keep])

    joined = side(first, "1").join(side(second, "2"), "name", "full_outer")
    presence = (
        F.when(F.col("dtype_2").isNull(), "first_only")
        .when(F.col("dtype_1").isNull(), "second_only")
        .otherwise("common")
    )
    return joined.withColumn("presence", presence)


HISTORY = "dataset_id string, version long, created_at timestamp, rows long, columns long, overall_score double, report string"


def append_profile(report: Report, path: str, dataset_id: str) -> int:
    """Append the report under the next version number of its dataset; returns it.

    One writer per dataset at a time: plain Parquet has no compare-and-swap.
    """
    spark = report.basic_info.sparkSession
    latest = None
    if _exists(spark, path):
        kept = spark.read.schema(HISTORY).parquet(path).filter(F.col("dataset_id") == dataset_id)
        latest = kept.agg(F.max("version")).first()[0]
    version = (latest or 0) + 1
    body = report.to_dict()
    row = result_frame(
        spark,
        [
            (
                dataset_id, version, None, body["basic_info"]["rows"], body["basic_info"]["columns"],
                body["quality_score"]["overall_score"], json.dumps(body, default=str),
            )
        ],
        HISTORY,
    ).withColumn("created_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema(HISTORY).parquet(path)
        return True
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def profile_history(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """All versions of a dataset, newest first."""
    if not _exists(spark, path):
        raise AnalysisError(f"No profile history at {path}")
    kept = spark.read.schema(HISTORY).parquet(path).filter(F.col("dataset_id") == dataset_id)
    return kept.orderBy(F.col("version").desc())


def latest_profiles(history: DataFrame, key: str = "dataset_id", version: str = "version") -> DataFrame:
    """The newest row per dataset of a history table."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return history.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
