"""Rank statistics from value counts and distributed running totals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.plans.layout import settle
from tabulon.plans.ordered import ROWS_PER_TASK, piece_column, running_sums, split_points

BROADCAST_LIMIT = 200_000
BINS_PER_GROUP = 128
MAX_DEPTH = 4
MAX_CUTS = 4096  # of one level on one axis: group numbers of all levels fit a bigint


def average_ranks(
    rows: DataFrame, value: str, total: int, weights: dict[str, Column], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """One row per distinct value: its ``weights``, their sum ``ties``, and ``rank``."""
    counted = rows.groupBy(value).agg(*[w.alias(k) for k, w in weights.items()])
    counted = counted.withColumn("ties", sum((F.col(k) for k in weights), F.lit(0)).cast("long"))
    placed = running_sums(
        counted, {"upto": F.col("ties")}, [value], total=total, rows_per_task=rows_per_task, source=rows
    )
    rank = F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2
    return placed.withColumn("rank", rank).drop("upto")


def two_sample_ranks(rows: DataFrame, total: int, rows_per_task: int = ROWS_PER_TASK) -> dict:
    """Rank sum of the first sample and the tie term, for rows (sample 0/1, value)."""
    weights = {"first": F.count_if(F.col("sample") == 0), "second": F.count_if(F.col("sample") == 1)}
    ranked = average_ranks(rows, "value", total, weights, rows_per_task)
    t = F.col("ties").cast("double")
    return (
        ranked.agg(
            F.sum(F.col("first") * F.col("rank")).alias("rank_sum"),
            F.sum(t * t * t - t).alias("tie_term"),
            F.max("ties").alias("largest_tie"),
        )
        .first()
        .asDict()
    )


def spearman_r(pairs: DataFrame, n: int, rows_per_task: int = ROWS_PER_TASK) -> float | None:
    """Pearson correlation of average ranks, for complete rows (x, y)."""
    middle = (n + 1) / 2
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    spreads = []
    for side in ("x", "y"):
        ranked = settle(average_ranks(pairs.select(side), side, n, {"w": F.count(F.lit(1))}, rows_per_task))
        found = ranked.agg(
            F.sum(F.col("w") * (F.col("rank") - middle) ** 2).alias("s"), F.count(F.lit(1)).alias("k")
        ).first()
        spreads.append(found["s"])
        table = ranked.select(side, F.col("rank").alias(f"r{side}"))
        if found["k"] <= BROADCAST_LIMIT:
            table = F.broadcast(table)
        counted = counted.join(table, side)
    if not spreads[0] or not spreads[1]:
        return None
    cross = counted.agg(F.sum(F.col("c") * (F.col("rx") - middle) * (F.col("ry") - middle))).first()[0]
    return max(-1.0, min(1.0, cross / math.sqrt(spreads[0]) / math.sqrt(spreads[1])))


def tie_sums(pairs: DataFrame, keys: list[str]) -> tuple[float, float, float]:
    """Sums over tied groups of t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5)."""
    t = F.col("count").cast("double")
    row = (
        pairs.groupBy(*keys)
        .count()
        .agg(
            F.sum(t * (t - 1) / 2).alias("a"),
            F.sum(t * (t - 1) * (t - 2)).alias("b"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias("c"),
        )
        .first()
    )
    return row["a"], row["b"], row["c"]


def weighted_inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weight of pairs with smaller x and larger y, by halving the y ranks bit by bit."""
    order = np.lexsort((y, x))
    _, rank = np.unique(y[order], return_inverse=True)
    weight = w[order].astype(float)
    total = 0.0
    for level in range(int(rank.max()).bit_length() if rank.size else 0):
        block = rank >> (level + 1)
        by_block = np.argsort(block, kind="stable")
        block, upper, wt = block[by_block], (rank[by_block] >> level) & 1, weight[by_block]
        above = np.cumsum(wt * upper)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        offset = np.repeat(np.r_[0.0, above][starts], np.diff(np.r_[starts, block.size]))
        total += float(np.sum(wt * (1 - upper) * (above - offset)))
    return total


def discordant_pairs(pairs: DataFrame, n: int, rows_per_task: int = ROWS_PER_TASK) -> float:
    """Pairs ordered one way in x and the other way in y, ties in neither.

    Both axes are cut at sampled values. Each cut value is a bin of its own, so a
    value that fills a third of the table needs no work inside its bin. Pairs in
    different bins on both axes follow from the bin counts. Pairs that share an
    open bin are counted inside it, in parallel; bins still too large for a task
    are cut again.
    """
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    return _discordant(settle(counted.select(F.lit(0).cast("long").alias("g"), "x", "y", "c")), n, rows_per_task, 0)


def _discordant(rows: DataFrame, total: int, rows_per_task: int, depth: int) -> float:
    """Discordant weight within each group ``g`` of (g, x, y, c)."""
    if total > rows_per_task:
        size = rows.groupBy("g").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        most, total = size["most"] or 0, size["all"] or 0
    else:
        most = total
    if most <= rows_per_task or depth == MAX_DEPTH:
        counted = rows.groupBy("g").applyInPandas(_count_inside, "found double")
        return counted.agg(F.sum("found")).first()[0] or 0.0

    binned = rows
    for side in ("x", "y"):
        points = _thinned(split_points(rows, ["g", side], min(MAX_CUTS, -(-total // rows_per_task) * 2), total))
        below = piece_column(rows, ["g", side], points)
        cuts = F.array(*[F.struct(F.lit(p[0]).cast("long").alias("g"), F.lit(p[1]).cast("double").alias("v")) for p in points])
        here = F.struct(F.col("g").alias("g"), F.col(side).alias("v"))
        on_cut = (below > 0) & (F.get(cuts, below - 1) == here)
        binned = binned.withColumn(f"{side}b", below * 2 - F.when(on_cut, 1).otherwise(0))
    cells = binned.groupBy("g", "xb", "yb").agg(F.sum("c").alias("c"))
    across = cells.groupBy("g").applyInPandas(_count_across, "found double").agg(F.sum("found")).first()[0] or 0.0

    # Next level: rows sharing an open x bin, and rows sharing an open y bin, where
    # only the x bin still matters. Group numbers stay apart by kind.
    width = 2 * MAX_CUTS + 2
    by_x = binned.filter(F.col("xb") % 2 == 0).select(
        ((F.col("g") * width + F.col("xb")) * 2).alias("g"), "x", "y", "c"
    )
    strips = binned.filter(F.col("yb") % 2 == 0).groupBy("g", "yb", "xb", "y").agg(F.sum("c").alias("c"))
    by_y = strips.select(
        ((F.col("g") * width + F.col("yb")) * 2 + 1).alias("g"), F.col("xb").cast("double").alias("x"), "y", "c"
    )
    return across + _discordant(settle(by_x.unionByName(by_y)), 2 * total, rows_per_task, depth + 1)


def _thinned(points: list) -> list:
    """At most ``BINS_PER_GROUP`` cut points of each group, evenly taken."""
    groups: dict = {}
    for p in points:
        groups.setdefault(p[0], []).append(p)
    out = []
    for members in groups.values():
        step = -(-len(members) // BINS_PER_GROUP)
        out += members[::step]
    return out


def _count_inside(part: pd.DataFrame) -> pd.DataFrame:
    found = weighted_inversions(part["x"].to_numpy(), part["y"].to_numpy(), part["c"].to_numpy())
    return pd.DataFrame({"found": [found]})


def _count_across(part: pd.DataFrame) -> pd.DataFrame:
    """Weight of cell pairs with smaller x bin and larger y bin, from 2-D prefix sums."""
    xs, x = np.unique(part["xb"], return_inverse=True)
    ys, y = np.unique(part["yb"], return_inverse=True)
    grid = np.zeros((len(xs), len(ys)))
    grid[x, y] = part["c"]
    beyond = np.zeros_like(grid)  # weight at larger x and smaller y
    tail = np.cumsum(grid[::-1], axis=0)[::-1]
    beyond[:-1, 1:] = np.cumsum(tail[1:], axis=1)[:, :-1]
    return pd.DataFrame({"found": [float(np.sum(grid * beyond))]})
