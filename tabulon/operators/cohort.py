"""Retention of entities by the period they were first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, is_missing, require
from tabulon.functions.parsing import as_timestamp
from tabulon.plans.layout import settle

MAX_PERIODS = 400  # of a matrix, either way
FREQUENCIES = {"D": "day", "W": "week", "M": "month", "Q": "quarter"}


def period_start(at: Column, freq: str) -> Column:
    return F.date_trunc(FREQUENCIES[freq], at).cast("date")


def period_label(start: Column, freq: str) -> Column:
    if freq == "D":
        return start.cast("string")
    if freq == "W":
        return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))
    if freq == "M":
        return F.date_format(start, "yyyy-MM")
    return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))


def period_distance(start: Column, first: Column, freq: str) -> Column:
    if freq == "D":
        return F.datediff(start, first)
    if freq == "W":
        return (F.datediff(start, first) / 7).cast("int")
    months = (F.year(start) - F.year(first)) * 12 + F.month(start) - F.month(first)
    return months if freq == "M" else (months / 3).cast("int")


def cohort(df: DataFrame, entity: str, date: str, freq: str = "M") -> DataFrame:
    """One row per (cohort, period index) with activity: entities, cohort size, rate.

    Activity is reduced to distinct (entity, period) pairs before anything is
    grouped by entity, so one entity owns at most as many rows as there are periods.
    """
    require(df, entity, date)
    freq = freq.upper()
    if freq not in FREQUENCIES:
        raise AnalysisError("freq must be one of D, W, M, Q")
    rows = df.filter(~is_missing(df, entity)).select(
        col(entity).alias("entity"), period_start(as_timestamp(df, date), freq).alias("period")
    )
    rows = rows.filter(F.col("period").isNotNull())
    if rows.isEmpty():
        raise AnalysisError("No valid cohort data after date parsing")
    pairs = rows.groupBy("entity", "period").agg(F.lit(1).alias("one"))
    # An entity has a row for each of its periods here, however often it was active.
    active = pairs.withColumn("first", F.min("period").over(Window.partitionBy("entity")))
    counted = active.groupBy("first", "period").agg(F.count(F.lit(1)).alias("active_users"))
    # Every entity is active in its first period, so that cell is the cohort size.
    cohort_rows = Window.partitionBy("first")  # a row for each period
    size = F.max(F.when(F.col("period") == F.col("first"), F.col("active_users"))).over(cohort_rows)
    return counted.withColumn("cohort_size", size).select(
        period_label(F.col("first"), freq).alias("cohort"),
        period_distance(F.col("period"), F.col("first"), freq).alias("period_index"),
        "cohort_size",
        "active_users",
        (F.col("active_users") / F.col("cohort_size") * 100).alias("retention_rate"),
    )


def cohort_matrix(
    df: DataFrame, entity: str, date: str, freq: str = "M", measure: str = "retention_rate", max_periods: int = MAX_PERIODS
) -> DataFrame:
    """The same as a matrix: one row per cohort, one column per period index, absent cells
    null. More than ``max_periods`` cohorts or period indexes raise: the long form has no
    such bound."""
    if measure not in ("retention_rate", "active_users"):
        raise AnalysisError("measure must be retention_rate or active_users")
    long = settle(cohort(df, entity, date, freq))
    # Distinct first: two rows of partial counts, however many cells there are.
    shape = long.agg(F.count_distinct("cohort").alias("cohorts"), F.count_distinct("period_index").alias("indexes")).first()
    if max(shape["cohorts"], shape["indexes"]) > max_periods:
        raise AnalysisError(
            f"{shape['cohorts']} cohorts and {shape['indexes']} periods are more than {max_periods}: "
            "try a coarser frequency, a higher limit or the long form"
        )
    indexes = sorted(r["period_index"] for r in long.select("period_index").distinct().collect())
    cells = long.groupBy("cohort", "cohort_size").pivot("period_index", indexes).agg(F.first(measure))
    names = [F.col(f"`{i}`").alias(f"period_{i}") for i in indexes]
    return cells.select("cohort", "cohort_size", *names).orderBy("cohort")
