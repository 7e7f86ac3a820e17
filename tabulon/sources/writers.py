"""CSV and report output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col
from tabulon.operators.compare import Report
from tabulon.operators.rows import sanitize_formulas


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Formula-safe CSV with a header, one file per task."""
    sanitize_formulas(df).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    out = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
            value = F.when(~bad, value)
        out.append(value.alias(f.name))
    return df.select(*out)


def report_tables(df: DataFrame, report: Report) -> dict[str, DataFrame]:
    """The five sheets of a report."""
    summary = report.column_analysis.select(
        F.col("name").alias("Column"),
        F.col("dtype").alias("Type"),
        F.col("missing_count").alias("Missing"),
        F.col("missing_percent").alias("Missing %"),
        F.col("unique_count").alias("Unique"),
        F.col("mean").alias("Mean"),
        F.col("median").alias("Median"),
        F.col("std").alias("Std"),
        F.col("min").alias("Min"),
        F.col("max").alias("Max"),
    )
    quality = report.quality_breakdown.select(
        F.initcap(F.replace("dimension", F.lit("_"), F.lit(" "))).alias("Component"),
        F.col("score").alias("Score"),
        F.col("weight").alias("Weight"),
        F.col("details").alias("Details"),
    )
    return {
        "Data": df,
        "Summary": summary,
        "Correlations": report.correlation_matrix,
        "Outliers": report.outliers,
        "Quality": quality,
    }


def write_report_tables(
    df: DataFrame, report: Report, path: str, format: str = "parquet", mode: str = "errorifexists"
) -> list[str]:
    """Write each sheet under ``path``; text is formula-safe, JSON has no NaN."""
    if format not in ("parquet", "csv", "json"):
        raise AnalysisError("format must be parquet, csv or json")
    written = []
    for name, frame in report_tables(df, report).items():
        safe = sanitize_formulas(frame)
        target = f"{path.rstrip('/')}/{name}"
        if format == "csv":
            safe.write.mode(mode).csv(target, header=True, quote='"', escape='"')
        elif format == "json":
            json_safe(safe).write.mode(mode).json(target, ignoreNullFields=False)
        else:
            safe.write.mode(mode).parquet(target)
        written.append(target)
    return written
