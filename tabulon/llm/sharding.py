"""Sharding by Karmarkar-Karp differencing: near-equal bytes with equal texts kept together.

Groups of equal texts larger than a small share of a shard are items of their own; the
many small ones are gathered by hash into a fixed number of items. The number of items
is thus bounded whatever the input, and their sizes are sums that Spark has aggregated.
Differencing starts from one partial partition an item and repeatedly combines the two of
the largest spread, the largest part of one with the smallest of the other.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.llm.common import col, cut, fresh

SHARDS = 40
OVERHEAD = 16  # bytes that each row takes besides its text
FINE = 128  # items a shard: groups over total / (shards * FINE) bytes are items of their own
ROWS_PER_TASK = 100_000  # rows numbered together


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part, 0 to parts - 1, of each size; parts are numbered from the largest sum."""
    if not sizes:
        return []
    n = len(sizes)
    sums = np.zeros((2 * n - 1, parts), dtype=np.int64)  # of each partial partition, falling
    sums[:n, 0] = sizes
    order = np.zeros((2 * n - 1, parts), dtype=np.int32)  # where each part stood before sorting
    children = np.zeros((2 * n - 1, 2), dtype=np.int64)
    heap = [(-size, i) for i, size in enumerate(sizes)]  # of a single item the spread is its size
    if parts == 1:
        return [0] * n
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joint = sums[a] + sums[b][::-1]
        order[node] = np.argsort(-joint, kind="stable")
        sums[node] = joint[order[node]]
        children[node] = a, b
        heapq.heappush(heap, (int(sums[node, -1] - sums[node, 0]), node))
    place = np.zeros((2 * n - 1, parts), dtype=np.int32)  # part of the whole that each part ends in
    place[2 * n - 2] = np.arange(parts)
    for node in range(2 * n - 2, n - 1, -1):
        a, b = children[node]
        before = np.empty(parts, dtype=np.int32)
        before[order[node]] = place[node]
        place[a] = before
        place[b] = before[::-1]
    return place[:n, 0].tolist()


def assign(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", result: str = "shard") -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and that column's name (`result`, made longer
    where the input has such a column). Its fields: size (UTF-8 bytes and OVERHEAD),
    text_crc32 and shard.

    Equal texts share a shard, null and empty ones too (both have no bytes and checksum 0).
    A group larger than a shard's share makes its shard that much larger; the rest is
    balanced around it. The rows are not shuffled: only group sums are.
    """
    name = fresh(docs, result)
    text = F.coalesce(col(text_col), F.lit(""))
    size = F.octet_length(text).cast("bigint") + OVERHEAD
    group = F.xxhash64(text)  # texts that share a hash are kept together too, which does no harm
    groups = cut(docs.select(group.alias("group"), size.alias("size")).groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    items = shards * FINE
    large = F.col("bytes") * items >= total
    chunk = F.pmod(F.xxhash64(F.col("group")), F.lit(items))
    # At most `items` groups can be that large, and there are as many chunks.
    rows = [(0, r["group"], r["bytes"]) for r in groups.where(large).collect()]
    rows += [(1, r["chunk"], r["bytes"]) for r in groups.where(~large).groupBy(chunk.alias("chunk")).agg(F.sum("bytes").alias("bytes")).collect()]
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))
    placed = difference([r[2] for r in rows], shards)
    spark = docs.sparkSession
    tables = [
        spark.createDataFrame([(r[1], p) for r, p in zip(rows, placed, strict=True) if r[0] == kind], f"{key} bigint, {key}_shard int")
        for kind, key in ((0, "own"), (1, "chunk"))
    ]
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group.alias("group"))
    keyed = keyed.withColumn("chunk", chunk).join(F.broadcast(tables[0]), F.col("group") == F.col("own"), "left").join(F.broadcast(tables[1]), "chunk", "left")
    found = F.struct("size", "text_crc32", F.coalesce("own_shard", "chunk_shard").alias("shard"))
    return keyed.select(*[F.col("row")[c].alias(c) for c in docs.columns], found.alias(name)), name


def number_slots(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows (id, size, text_crc32, shard) with their slot: 0, 1, 2, ... without gaps in each
    shard. A shard is numbered in parts of about ROWS_PER_TASK rows, so no task gets one whole."""
    rows = cut(rows, "sizes")
    most = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // ROWS_PER_TASK) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64(col(id_col), "text_crc32", "size"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = counts.select("shard", "part", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside).join(offsets, ["shard", "part"])
    return numbered.withColumn("slot", (F.col("inside") + F.col("offset")).cast("bigint")).drop("part", "inside", "offset")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text", files: int = 8) -> None:
    """Write the documents as Parquet, one folder a shard with about `files` files each."""
    found, name = assign(docs, shards, text_col)
    by = fresh(docs, "shard_number")
    rows = found.withColumn(by, F.col(name)["shard"]).drop(name)
    salt = F.pmod(F.xxhash64(*[col(c) for c in docs.columns]), F.lit(files))
    rows.repartition(col(by), salt).write.partitionBy(by).parquet(path)
