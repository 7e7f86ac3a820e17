"""Exact count of repeated rows without shuffling whole rows in the usual case."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import groupable
from tabulon.plans.tallies import combined, summed

VERIFY_LIMIT = 500_000


def duplicate_rows(df: DataFrame, verify_limit: int = VERIFY_LIMIT, total: int | None = None) -> int:
    """Rows minus distinct rows, nulls equal.

    Equal rows always share a fingerprint, so a table whose fingerprints are all
    different is done after one shuffle of fingerprints. Fingerprints that occur
    more than once are settled on the full rows. The ``total`` of rows is counted when absent.
    """
    if not df.columns:
        return 0
    rows = df.select(*[groupable(df, n).alias(f"c{i}") for i, n in enumerate(df.columns)])
    cells = [F.col(c) for c in rows.columns]
    holes = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    marked = rows.withColumn("__a", F.xxhash64(holes, *cells)).withColumn("__b", F.hash(*cells, holes))
    total = df.count() if total is None else total
    parts = combined(marked.select("__a", "__b"), [{"__a": "__a", "__b": "__b"}], {"__a": "long", "__b": "int"})
    repeated = (
        summed(parts, ["__a", "__b"], total, F.sum("n").alias("n"))
        .filter("n > 1")
        .select("__a", "__b")
        .persist()
    )
    try:
        found = repeated.count()
        if found == 0:
            return 0
        if found <= verify_limit:
            marked = marked.join(F.broadcast(repeated), ["__a", "__b"], "left_semi")
        exact = marked.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
        return exact.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    finally:
        repeated.unpersist()
