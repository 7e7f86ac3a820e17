"""Partition layout of the input."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F, types as T

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col


SMALL_ROWS = 5_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Use every core on a table counted to be small; leave larger ones as they are.

    A file with one row group is scanned by one task however many cores there are.
    """
    if rows > SMALL_ROWS:
        return df
    spark = df.sparkSession
    pieces = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # By content, so that a task that runs again sends every row to the same place.
    return df.repartition(pieces, F.xxhash64(*plain)) if plain else df.repartition(pieces)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several later jobs read.

    It is written once to the checkpoint folder that all executors share, so a lost executor
    does not make it be computed again. A session on one machine without such a folder gets
    one; on a cluster spark.checkpoint.dir must name it.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise AnalysisError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabulon-"))
    return df.checkpoint()
