"""Hard negatives of anchor vectors, found through summaries of vector segments.

For each vector the means and deviations of its segments are stored: of the whole vector,
its halves, quarters and eighths. The inner product of two segments of m components lies
within m * mean * mean plus or minus m * deviation * deviation, so sums over the segments
bound a score from both sides. Pairs whose bounds rule them out are dropped at the first
level that can tell; only the others are scored exactly.

Anchors are the stated query set: batches of a bounded size are sent to all tasks, each
of which reads its rows once, keeps the best of them for each anchor, and hands on these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import col, cut

LEVELS = (1, 2, 4, 8)  # segments a vector is cut into, level by level
BATCH_ANCHORS = 1 << 16  # anchors sent out together,
BATCH_BYTES = 32 << 20  # and bytes of their vectors
TILE = 1024  # anchors, and twice as many rows, that are looked at together
SPARSE = 0.05  # share of pairs left below which they are looked at one by one
SLACK = 1e-6  # of the product of two vectors' lengths: what rounding may cost a bound
EXACT = 1 << 53  # whole numbers that a double holds
BUFFER = 1 << 18  # candidates held before they are ranked


def _edges(dim: int, segments: int) -> np.ndarray:
    return np.linspace(0, dim, min(segments, dim) + 1).astype(int)


def summarise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, side by side."""
    dim, means, deviations = vectors.shape[1], [], []
    for segments in LEVELS if dim else ():
        edges = _edges(dim, segments)
        sizes = np.diff(edges)
        mean = np.add.reduceat(vectors, edges[:-1], axis=1) / sizes
        square = np.add.reduceat((vectors - np.repeat(mean, sizes, axis=1)) ** 2, edges[:-1], axis=1) / sizes
        means.append(mean)
        deviations.append(np.sqrt(square))
    if not dim:
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    return np.concatenate(means, axis=1), np.concatenate(deviations, axis=1)


@dataclass
class Block:
    """Vectors of one length with their summaries."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    def __post_init__(self) -> None:
        dim, start = self.vectors.shape[1], 0
        self.levels = []  # so scaled that a product of two rows is a sum over segments
        for segments in LEVELS if dim else ():
            sizes = np.sqrt(np.diff(_edges(dim, segments)))
            stop = start + len(sizes)
            self.levels.append((self.means[:, start:stop] * sizes, self.deviations[:, start:stop] * sizes))
            start = stop
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def rows(self, low: int, high: int) -> Block:
        return Block(*(x[low:high] for x in (self.ids, self.labels, self.vectors, self.means, self.deviations)))


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """The rows of a batch by length of their vectors."""
    def lists(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name)
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(kind)

    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    offsets, values = lists("vector", np.float64)
    others = [lists(c, np.float64) for c in ("means", "deviations")]
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        parts = [values[offsets[at][:, None] + np.arange(dim)]]
        for where, numbers in others:
            width = int(np.diff(where)[at[0]])
            parts.append(numbers[where[at][:, None] + np.arange(width)])
        yield Block(ids[at], labels[at], *parts)


def products(a: Block, b: Block) -> np.ndarray:
    """All inner products of whole-numbered vectors, exact."""
    bound = a.largest * b.largest * a.vectors.shape[1]
    if bound < EXACT:
        return (a.vectors @ b.vectors.T).astype(np.int64)
    return a.vectors.astype(np.int64) @ b.vectors.astype(np.int64).T


class Search:
    """The `k` best rows of each slot of each anchor. A slot asks for scores from `lows` to
    `highs` among the rows of the anchor's own label (`same`) or of all others."""

    def __init__(self, anchors: Block, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> None:
        self.anchors, self.highs, self.same, self.k = anchors, highs, same, k
        self.needed = lows.copy()  # the least score that still counts
        self.slots = lows.shape[1]
        self.kept = [np.zeros(0, dtype=np.int64)] * 3  # slot, score, id
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        self.tiles = [(a, anchors.rows(a, a + TILE)) for a in range(0, len(anchors.ids), TILE)]
        self.size = 64
        self.scored = 0

    def add(self, rows: Block) -> None:
        """Rows in steps that grow while the least scores rise."""
        if self.anchors.largest * rows.largest * rows.vectors.shape[1] >= 2.0**63:
            raise ValueError("scores beyond 64-bit whole numbers")
        low = 0
        while low < len(rows.ids):
            part = rows.rows(low, low + self.size)
            for start, tile in self.tiles:
                self._tile(start, tile, part)
                if self.n_waiting > BUFFER:
                    self.rank()
            self.rank()
            low += self.size
            self.size = min(4 * self.size, 2 * TILE)

    def _tile(self, start: int, anchors: Block, rows: Block) -> None:
        stop = start + len(anchors.ids)
        open_slots = self.needed[start:stop] <= self.highs[start:stop]
        least = np.where(open_slots, self.needed[start:stop], np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
        most = np.where(open_slots, self.highs[start:stop], np.iinfo(np.int64).min).max(axis=1).astype(np.float64)
        left = (anchors.labels[:, None] == rows.labels[None, :]) == self.same
        left &= anchors.ids[:, None] != rows.ids[None, :]
        left &= open_slots.any(axis=1)[:, None]
        pairs = None
        for (mean, deviation), (row_mean, row_deviation) in zip(anchors.levels, rows.levels, strict=True):
            if pairs is None and left.mean() < SPARSE:
                pairs = np.nonzero(left)
            if pairs is None:
                middle, reach = mean @ row_mean.T, deviation @ row_deviation.T
                reach += SLACK * anchors.norms[:, None] * rows.norms[None, :]
                left &= (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
            else:
                a, r = pairs
                middle, reach = (mean[a] * row_mean[r]).sum(axis=1), (deviation[a] * row_deviation[r]).sum(axis=1)
                reach += SLACK * anchors.norms[a] * rows.norms[r]
                on = (middle + reach >= least[a]) & (middle - reach <= most[a])
                pairs = a[on], r[on]
        if pairs is None and left.mean() < SPARSE:
            pairs = np.nonzero(left)
        if pairs is None:
            scores = products(anchors, rows)
            self.scored += int(left.sum())
            for slot in range(self.slots):
                hit = left & (scores >= self.needed[start:stop, slot, None]) & (scores <= self.highs[start:stop, slot, None])
                a, r = np.nonzero(hit)
                self._hold(start + a, slot, scores[a, r], rows.ids[r])
        elif len(pairs[0]):
            a, r = pairs
            self.scored += len(a)
            scores = _paired(anchors, rows, a, r)
            for slot in range(self.slots):
                hit = (scores >= self.needed[start + a, slot]) & (scores <= self.highs[start + a, slot])
                self._hold(start + a[hit], slot, scores[hit], rows.ids[r[hit]])

    def _hold(self, anchor: np.ndarray, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(anchor):
            self.waiting.append((anchor * self.slots + slot, scores, ids))
            self.n_waiting += len(anchor)

    def rank(self) -> None:
        if not self.waiting:
            return
        slot, score, ids = (np.concatenate(x) for x in zip(self.kept, *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        last = rank == self.k - 1
        needed = self.needed.reshape(-1)
        needed[slot[last]] = np.maximum(needed[slot[last]], score[last])
        keep = rank < self.k
        self.kept = [slot[keep], score[keep], ids[keep]]


def _paired(anchors: Block, rows: Block, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    bound = anchors.largest * rows.largest * anchors.vectors.shape[1]
    kind = np.float64 if bound < EXACT else np.int64
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), 1 << 16):
        x, y = anchors.vectors[a[at : at + (1 << 16)]].astype(kind), rows.vectors[r[at : at + (1 << 16)]].astype(kind)
        out[at : at + (1 << 16)] = (x * y).sum(axis=1).astype(np.int64)
    return out


STORED = "id bigint, label bigint, anchor boolean, place bigint, vector array<bigint>, means array<float>, deviations array<float>"
FOUND = "anchor int, slot int, score bigint, id bigint"


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width or 1, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, dtype=np.int32)), pa.array(matrix.reshape(-1), kind))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the summaries of their vectors."""
    names = [f.split()[0] for f in STORED.split(", ")]
    for batch in batches:
        vector = batch.column("vector")
        offsets, values = vector.offsets.to_numpy(), vector.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            numbers = values[offsets[at][:, None] + np.arange(dim)]
            means, deviations = summarise(numbers.astype(np.float64))
            kept = batch.take(pa.array(at))
            columns = [kept.column(c) for c in names[:4]]
            columns += [_lists(numbers, pa.int64()), _lists(means, pa.float32()), _lists(deviations, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _search(rows: DataFrame, table: pa.Table, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> DataFrame:
    """The best rows of each slot that each task finds (FOUND, `anchor` being its number)."""
    shared = rows.sparkSession.sparkContext.broadcast((table, lows, highs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lows, highs = shared.value
        searches: dict[int, tuple[np.ndarray, Search]] = {}
        sizes = np.diff(np.concatenate([[0], np.cumsum([len(v) for v in table.column("vector")])]))
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            own = next(blocks(table.take(pa.array(at)).combine_chunks().to_batches()[0]))
            searches[dim] = at, Search(own, lows[at], highs[at], same, k)
        for batch in batches:
            for block in blocks(batch):
                if block.vectors.shape[1] in searches:
                    searches[block.vectors.shape[1]][1].add(block)
        for at, search in searches.values():
            slot, score, ids = search.kept
            out = [pa.array(at[slot // search.slots], pa.int32()), pa.array(slot % search.slots, pa.int32()), pa.array(score), pa.array(ids)]
            yield pa.RecordBatch.from_arrays(out, names=["anchor", "slot", "score", "id"])

    columns = ["id", "label", "vector", "means", "deviations"]
    found = rows.select(*columns).mapInArrow(run, FOUND)
    best = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "id",
    vector_col: str = "vector",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """For each anchor (a row for which `anchor` holds) and each of its `positives` best rows
    of the same label, the `negatives` best rows of other labels whose score is from `low` to
    `high` hundredths of the positive's: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. Scores are inner products of the whole-numbered vectors;
    higher ones come first, of equal ones the smaller id.

    Rows with a null id, label, vector or component take no part. Vectors are compared with
    those of their own length; empty ones score 0. Rows that repeat an id are rows of their
    own, but none is a positive of an anchor with its id. No rows, or anchors without
    fitting rows, give none. Scores beyond 64 bits raise ValueError. Other columns are not
    looked at. The result is in the shared folder.
    """
    spark = rows.sparkSession
    vector = col(vector_col).cast("array<bigint>")
    fits = col(id_col).isNotNull() & col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    source = rows.where(fits).select(
        col(id_col).cast("bigint").alias("id"), col(label_col).cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("place"), vector.alias("vector"),
    )
    stored = cut(source.mapInArrow(_store, STORED), "vectors")
    size = stored.where("anchor").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    together = max(1, min(BATCH_ANCHORS, BATCH_BYTES // (8 * (size["dim"] or 1))))
    batches = -(-size["n"] // together)
    parts = []
    for batch in range(batches):
        anchors = stored.where(F.col("anchor") & (F.pmod(F.xxhash64("place"), F.lit(batches)) == batch)).select("id", "label", "vector", "means", "deviations")
        anchors = anchors.toArrow()  # about `together` of them
        n = anchors.num_rows
        if not n:
            continue
        everything = np.iinfo(np.int64)
        found = _search(stored, anchors, np.full((n, 1), everything.min + 1), np.full((n, 1), everything.max), True, positives)
        # At most `positives` rows an anchor of the batch.
        best = found.select("anchor", "rank", "score", "id").toPandas()
        scores, ids = (np.zeros((n, positives), dtype=np.int64) for _ in range(2))
        known = np.zeros((n, positives), dtype=bool)
        at = best["anchor"].to_numpy(), best["rank"].to_numpy() - 1
        scores[at], ids[at], known[at] = best["score"], best["id"], True
        # low * positive <= 100 * negative <= high * positive; a slot without a positive is shut.
        lows = np.where(known, [[-(-(low * s) // 100) for s in r] for r in scores.tolist()], 1)
        highs = np.where(known, [[(high * s) // 100 for s in r] for r in scores.tolist()], 0)
        found = _search(stored, anchors, lows.astype(np.int64), highs.astype(np.int64), False, negatives)
        own = anchors.column("id").to_pylist()
        slots = [(a, p, own[a], int(ids[a, p]), int(scores[a, p])) for a, p in zip(*np.nonzero(known), strict=True)]
        slots = [(int(a), int(p), *rest) for a, p, *rest in slots]
        pairs = spark.createDataFrame(slots, "anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint")
        # `found` holds up to `negatives` rows for each row of `pairs`, which is bounded as the batch is.
        parts.append(
            cut(
                found.join(F.broadcast(pairs), ["anchor", "slot"]).select(
                    "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
                ),
                "negatives",
            )
        )
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, parts)
