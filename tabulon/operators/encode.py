"""Codes for categorical values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import col
from tabulon.plans.ordered import ROWS_PER_TASK, with_positions

BROADCAST_LIMIT = 200_000


def domain_codes(df: DataFrame, name: str, code: str, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, int]:
    """(value, code) with codes from 0 in value order, and the number of values."""
    values = df.select(col(name)).filter(col(name).isNotNull()).distinct()
    size = values.count()
    placed = with_positions(values, [name], name=code, total=size, rows_per_task=rows_per_task)
    return placed.withColumn(code, (col(code) - 1).cast("long")), size


def code_column(
    df: DataFrame, name: str, code: str, missing: int = -1, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add the sorted-domain code of a column; null gets ``missing``.

    The domain is broadcast only after its size is known to be small.
    """
    codes, size = domain_codes(df, name, code, rows_per_task)
    right = codes.select(col(name).alias("__value"), col(code))
    if size <= BROADCAST_LIMIT:
        right = F.broadcast(right)
    joined = df.join(right, col(name) == F.col("__value"), "left").drop("__value")
    return joined.withColumn(code, F.coalesce(col(code), F.lit(missing)))
