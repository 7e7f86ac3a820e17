"""Rows per key, without a map of all the keys that a task reads.

Spark combines equal keys of a task before the shuffle in a map of all of them; where keys
hardly repeat, that map is as large as what the task reads. Here equal keys are combined
within stretches of bounded size, so a key that fills a third of the table still leaves a
task a few times only. What is left is dealt by key to as many tasks as the rows need, and
summed up there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

STRETCH_ROWS = 500_000
STRETCH_BYTES = 64 << 20
FEW_KEYS = 20_000  # no task is started for less than this
MANY_KEYS = 20_000_000
INDEX = "column_index"
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def combined(df: DataFrame, groups: Sequence[dict[str, str]], lanes: dict[str, str]) -> DataFrame:
    """(column_index, lanes..., n): keys of each group with their rows, several times each.

    A group names the column behind each of its lanes; the other lanes are null. ``lanes``
    tells the types: int, long, double or string.
    """
    groups = [dict(g) for g in groups]
    types = {INDEX: ARROW["int"], **{k: ARROW[t] for k, t in lanes.items()}, "n": ARROW["long"]}

    def parts(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for index, group in enumerate(groups):
            filled = {lane: key for lane, key in group.items() if table[key].null_count < table.num_rows}
            if filled:
                keys = list(filled.values())
                found = table.select(keys).group_by(keys, use_threads=False).aggregate([([], "count_all")])
                given = {lane: found[key] for lane, key in filled.items()} | {"n": found["count_all"]}
            else:
                given = {"n": pa.array([table.num_rows])}
            size = len(given["n"])
            given[INDEX] = pa.nulls(size, ARROW["int"]).fill_null(index)
            columns = [given[k].cast(t) if k in given else pa.nulls(size, t) for k, t in types.items()]
            yield from pa.table(columns, names=list(types)).to_batches()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= STRETCH_ROWS or size >= STRETCH_BYTES:
                yield from parts(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from parts(held)

    schema = ", ".join([f"{INDEX} int", *[f"{k} {t}" for k, t in lanes.items()], "n long"])
    return df.mapInArrow(combine, schema)


def summed(parts: DataFrame, keys: Sequence[str], cells: int, *aggs: Column) -> DataFrame:
    """``parts`` grouped by ``keys``, dealt by key; ``cells`` bounds the number of keys.

    Up to the bypass threshold a task that writes to the shuffle passes its rows on; beyond
    it, it sorts them in memory first. So there are more tasks only for very many keys.
    """
    passed_on = int(parts.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    tasks = max(1, min(passed_on, -(-cells // FEW_KEYS)), -(-cells // MANY_KEYS))
    return parts.repartition(tasks, *[F.col(k) for k in keys]).groupBy(*keys).agg(*aggs)
