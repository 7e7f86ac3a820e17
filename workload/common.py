"""Helpers shared by the query modules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulon.functions.columns import col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, negative zero made zero, so that equal results print alike."""
    out = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), digits) + F.lit(0.0)
        out.append(value.alias(f.name))
    return df.select(*out)


def r(expression: str, digits: int = 4) -> str:
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0)"


def exact_r(expression: str, digits: int = 4) -> str:
    """Rounding of the exact binary value, as results rounded on the driver are."""
    return f"(format('{{:.{digits}f}}', ({expression})::DOUBLE)::DOUBLE + 0.0)"


def midpoint(source: str, column: str, q: float) -> str:
    """SQL for the quantile halfway between the two neighbouring values."""
    return (
        f"(SELECT avg(v) FROM (SELECT {column}::DOUBLE AS v, row_number() OVER (ORDER BY {column}) - 1 AS i, "
        f"count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL) "
        f"WHERE i = floor((n - 1) * {q}) OR i = ceil((n - 1) * {q}))"
    )


def linear(column: str, q: float) -> str:
    return f"quantile_cont({column}::DOUBLE, {q})"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name on the storage the cluster shares for checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tabulon-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


# Columns of the tables used by several modules.
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM_OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
# Gaps appear where a value says so, the same way on both sides.
GAPPY_SQL = (
    "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 25.0) AS l_quantity, "
    "l_extendedprice, nullif(l_discount, 0.0) AS l_discount, nullif(l_returnflag, 'N') AS l_returnflag, "
    "l_linestatus FROM lineitem)"
)


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nullif(l_quantity, 25.0D) AS l_quantity",
        "l_extendedprice", "nullif(l_discount, 0.0D) AS l_discount", "nullif(l_returnflag, 'N') AS l_returnflag",
        "l_linestatus",
    )
