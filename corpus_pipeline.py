"""A corpus pipeline of text operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm import langid
from tabulon.llm.common import bounded_batches, col, cut, fold, table
from tabulon.llm.decontaminate import decontaminate
from tabulon.llm.mixing import draws, mix_sources
from tabulon.llm.neardup import near_duplicates, small
from tabulon.llm.queries import HELD_OUT_FOLDS, shard_rows
from tabulon.shipping import ship

# No document is left out of the mixture; those of small sources are read up to so often.
MAX_PASSES = 1.5


def _ready(spark: SparkSession) -> None:
    ship(spark)
    bounded_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    _ready(spark)
    model = langid.fit(docs.where(fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0))
    found, name = langid.identify(docs, model)
    return found.where(~col(name)["rejected"]).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    _ready(spark)
    found = cut(near_duplicates(docs), "near")
    dropped = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(small(dropped, dropped.count()), "doc_id", "left_anti").select(*[col(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate."""
    _ready(spark)
    found, name = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~col(name)["contaminated"]).drop(name)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of underrepresented sources again."""
    mixed, name, _ = mix_sources(docs, ratio=None, max_passes=MAX_PASSES)
    read, _ = draws(mixed, name)
    return read.select(*[col(c) for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each reading."""
    return shard_rows(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("shards", shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
