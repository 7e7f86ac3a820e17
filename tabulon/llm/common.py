"""Helpers shared by the text operators and their queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name on the storage that all executors and the driver share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tabulon-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tabulon-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: later jobs do not compute
    it again, and no executor's loss takes it away. The caller's cleaning of that folder
    removes the files."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python workers in batches of about 4 MB: what a
    worker and its executor hold for a batch does not follow from the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of one byte a character take the fast way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


SPREAD = StorageLevel.MEMORY_AND_DISK
