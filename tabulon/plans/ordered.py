"""Ordered computations that do not funnel the table through one task.

A window without a partition key, or one whose partition is hot, sorts all of
its rows in a single task. The helpers here cut the sort order into pieces at
split points taken from a bounded sample, run the window inside each piece, and
add what earlier pieces carry over. The split points become literals in the
plan, so a lost executor recomputes exactly the same pieces; where the points
fall changes the balance of the work and never the result. Tables below
``rows_per_task`` use the plain window.

Rows that share their sort keys follow a hash of the whole row, in the plain window
as in the pieces: results repeat, and one timestamp that fills half of the table is
cut like any other stretch. Rows equal in every column can stand in any order; where
they alone fill more than a piece, they are numbered at random once, and the table
with these numbers is written before anything reads it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tabulon.functions.columns import col, row_hash
from tabulon.plans.layout import settle

ROWS_PER_TASK = 2_000_000
MAX_PIECES = 1 << 16
TREE_POINTS = 32  # so many are compared in a tree of conditions; more in a search whose plan stays small
SAMPLE_PER_PIECE = 40

PIECE = "__piece"
POSITION = "__position"
TIE = "__tie"
SALT = "__salt"


def largest_group(df: DataFrame, partition_by: Sequence[str]) -> int:
    """Row count of the biggest partition; partial counts combine before the shuffle."""
    if not partition_by:
        return df.count()
    sizes = df.groupBy(*[col(p) for p in partition_by]).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def split_points(df: DataFrame, keys: Sequence[str], pieces: int, total: int) -> list:
    """At most ``pieces - 1`` distinct sort-key rows from a bounded sample."""
    return _points(df, keys, pieces, total)[0]


def _points(df: DataFrame, keys: Sequence[str], pieces: int, total: int) -> tuple[list, bool]:
    """The split points, and whether one key filled a whole step between them."""
    fraction = min(1.0, SAMPLE_PER_PIECE * pieces / max(total, 1))
    picked = df.select(*[col(k) for k in keys]).sample(fraction=fraction, seed=11)
    sample = picked.orderBy(*[col(k) for k in keys]).limit(4 * SAMPLE_PER_PIECE * pieces).collect()
    step = max(1, len(sample) // pieces)
    points, full = [], False
    for row in sample[step::step]:
        if points and points[-1] == row:
            full = True
        else:
            points.append(row)
    return points, full


def piece_column(df: DataFrame, keys: Sequence[str], points: list) -> Column:
    """Number of split points at or before the row."""
    types = [df.schema[k].dataType for k in keys]
    single = len(keys) == 1 and all(p[0] is not None for p in points)
    if single:
        key = col(keys[0])
    else:
        key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])

    def literal(point) -> Column:
        values = [F.lit(v).cast(t) for v, t in zip(point, types)]
        if single:
            return values[0]
        return F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key >= literal(points[middle]), tree(middle + 1, high)).otherwise(
            tree(low, middle)
        )

    if len(points) <= TREE_POINTS:
        return tree(0, len(points))
    plain = (T.IntegralType, T.DoubleType, T.StringType, T.DateType, T.TimestampNTZType)
    if not single and all(isinstance(t, plain) for t in types):  # one text literal is quicker to plan than thousands of numbers
        rows = [{f"k{i}": v.isoformat() if isinstance(v, date) else v for i, v in enumerate(p) if v is not None} for p in points]
        schema = T.ArrayType(T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(types)]))
        sorted_points = F.from_json(F.lit(json.dumps(rows)), schema)
    else:
        sorted_points = F.array(*[literal(p) for p in points])

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        reached = F.coalesce(key >= F.get(sorted_points, middle), F.lit(False))
        return F.when(low >= high, state).otherwise(
            F.struct(F.when(reached, middle + 1).otherwise(low).alias("low"), F.when(reached, high).otherwise(middle).alias("high"))
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(points)).alias("high"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(len(points).bit_length())]), start, halve)["low"]


def cut(
    df: DataFrame,
    keys: Sequence[str],
    total: int,
    rows_per_task: int = ROWS_PER_TASK,
    source: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """``df`` with a piece number that increases along ``keys``, and the names of the
    columns that it was given to tell rows with equal keys apart.

    ``source`` may be a cheaper frame with the same key columns to sample from; the keys
    of ``df`` are then distinct.
    """
    pieces = min(MAX_PIECES, max(2, -(-total // rows_per_task)))
    if source is not None:
        return df.withColumn(PIECE, piece_column(df, keys, split_points(source, keys, pieces, total))), []
    extra = [TIE]
    if TIE not in df.columns:
        df = df.withColumn(TIE, row_hash(df))
    points, full = _points(df, [*keys, *extra], pieces, total)
    if full:
        extra = [TIE, SALT]
        df = settle(df.withColumn(SALT, (F.rand() * (1 << 30)).cast("int")))
        points = split_points(df, [*keys, *extra], pieces, total)
    return df.withColumn(PIECE, piece_column(df, [*keys, *extra], points)), extra


def in_order(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """The sort order of the plain windows."""
    return [*[col(o) for o in order_by], row_hash(df)]


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[f"`{name}`"].eqNullSafe(right[f"`{name}__r`"])
    return condition


def _attach(df: DataFrame, carried: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join of a carry table that holds at most one row per piece."""
    small = carried.select(*[col(k).alias(f"{k}__r") for k in keys], *[col(v) for v in values])
    joined = df.join(F.broadcast(small), _same(df, small, keys), "left")
    return joined.drop(*[f"{k}__r" for k in keys])


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    total: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` along ``order_by``.

    ``total`` is an upper bound of the biggest partition; counted when absent. With a
    ``source`` to sample from, ``order_by`` tells all rows of a partition apart.
    """
    if total is None:
        total = largest_group(df, partition_by)
    groups = [col(p) for p in partition_by]
    plain = (
        Window.partitionBy(*groups)
        .orderBy(*(in_order(df, order_by) if source is None else [col(o) for o in order_by]))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if total <= rows_per_task:
        return df.withColumns({name: F.sum(value).over(plain) for name, value in sums.items()})

    # ``total`` bounds the whole table when it comes with a source to sample from.
    rows = df.count() if partition_by and source is None else total
    staged = df.withColumns({f"__in_{name}": value for name, value in sums.items()})
    if source is None:  # of the caller's columns alone, as in the plain window
        staged = staged.withColumn(TIE, row_hash(df))
    pieces, extra = cut(staged, [*partition_by, *order_by], rows, rows_per_task, source)
    inside = (
        Window.partitionBy(F.col(PIECE), *groups)
        .orderBy(*[col(o) for o in [*order_by, *extra]])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Only the partition that straddles a cut has anything to carry, so the
    # carry table never has more rows than there are pieces.
    totals = pieces.groupBy(F.col(PIECE), *groups).agg(
        *[F.sum(f"__in_{name}").alias(f"__sum_{name}") for name in sums],
    )
    earlier = (
        Window.partitionBy(*groups)
        .orderBy(PIECE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        F.col(PIECE),
        *groups,
        F.count(F.lit(1)).over(earlier).alias("__before"),
        *[F.sum(f"__sum_{name}").over(earlier).alias(f"__off_{name}") for name in sums],
    ).filter("__before > 0")
    local = pieces.withColumns({name: F.sum(f"__in_{name}").over(inside) for name in sums})
    joined = _attach(local, carried, [PIECE, *partition_by], [f"__off_{name}" for name in sums])
    result = joined.withColumns(
        {
            name: F.when(F.col(f"__off_{name}").isNull(), col(name)).otherwise(
                F.coalesce(col(name), F.lit(0)) + F.col(f"__off_{name}")
            )
            for name in sums
        }
    )
    return result.drop(PIECE, *extra, *[f"__in_{n}" for n in sums], *[f"__off_{n}" for n in sums])


def with_positions(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = POSITION,
    total: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the 1-based position of each row along ``order_by``."""
    one = {name: F.lit(1).cast("long")}
    return running_sums(df, one, order_by, partition_by, total, rows_per_task)


def sliding(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    total: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add columns computed over at most ``before`` rows back and ``after`` ahead.

    Large partitions are laid out in equal blocks by position; rows near a block
    edge are copied to the neighbour that looks at them, and dropped afterwards.
    """
    if total is None:
        total = largest_group(df, partition_by)
    groups = [col(p) for p in partition_by]
    if total <= rows_per_task:
        spec = Window.partitionBy(*groups).orderBy(*in_order(df, order_by))
        return df.withColumns(build(spec))

    placed = with_positions(df, order_by, partition_by, total=total, rows_per_task=rows_per_task)
    block = max(rows_per_task, before + after, 1)
    home = F.floor((F.col(POSITION) - 1) / F.lit(block))
    offset = (F.col(POSITION) - 1) - home * block
    copies = F.filter(
        F.array(
            home,
            F.when(offset >= block - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        ),
        lambda b: b.isNotNull(),
    )
    laid = placed.withColumn("__home", home).withColumn("__block", F.explode(copies))
    spec = Window.partitionBy(*groups, F.col("__block")).orderBy(POSITION)
    return (
        laid.withColumns(build(spec))
        .filter(F.col("__block") == F.col("__home"))
        .drop(POSITION, "__home", "__block")
    )


def fill_forward(
    df: DataFrame,
    names: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    total: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Replace nulls by the latest earlier value; leading nulls stay."""
    if total is None:
        total = largest_group(df, partition_by)
    groups = [col(p) for p in partition_by]
    if total <= rows_per_task:
        spec = (
            Window.partitionBy(*groups)
            .orderBy(*in_order(df, order_by))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.withColumns({n: F.last(col(n), True).over(spec) for n in names})

    rows = df.count() if partition_by else total
    pieces, extra = cut(df, [*partition_by, *order_by], rows, rows_per_task)
    order = [col(o) for o in [*order_by, *extra]]
    inside = (
        Window.partitionBy(F.col(PIECE), *groups)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ends = pieces.groupBy(F.col(PIECE), *groups).agg(
        *[
            F.max_by(col(n), F.when(col(n).isNotNull(), place)).alias(f"__end_{i}")
            for i, n in enumerate(names)
        ]
    )
    earlier = (
        Window.partitionBy(*groups)
        .orderBy(PIECE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        F.col(PIECE),
        *groups,
        F.count(F.lit(1)).over(earlier).alias("__before"),
        *[F.last(f"__end_{i}", True).over(earlier).alias(f"__carry_{i}") for i in range(len(names))],
    ).filter("__before > 0")
    local = pieces.withColumns(
        {f"__fill_{i}": F.last(col(n), True).over(inside) for i, n in enumerate(names)}
    )
    carry = [f"__carry_{i}" for i in range(len(names))]
    joined = _attach(local, carried, [PIECE, *partition_by], carry)
    filled = joined.withColumns(
        {n: F.coalesce(F.col(f"__fill_{i}"), F.col(f"__carry_{i}")) for i, n in enumerate(names)}
    )
    return filled.select(*[col(n) for n in df.columns])
