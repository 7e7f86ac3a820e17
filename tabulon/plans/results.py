"""Small result frames built from driver-side rows (bounded by columns or groups)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def result_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def rounded(value: float | None, digits: int = 4) -> float | None:
    if value is None:
        return None
    value = float(value)
    return value if math.isnan(value) or math.isinf(value) else round(value, digits)
