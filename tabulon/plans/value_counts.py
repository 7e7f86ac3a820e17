"""One pass that counts every distinct value of every column.

Columns are unpivoted into typed lanes (whole numbers, fractions, text), so no
number is printed just to be counted and longs above 2^53 stay exact. Counts
combine in bounded stretches before the shuffle (``tallies``), which keeps a value that
fills a third of the table cheap and a column of distinct values out of a task's memory.

Texts of up to ``HEAD`` bytes are counted as they are. Of a longer one only its
first ``HEAD`` characters and a 128-bit fingerprint are shuffled, so counting a
corpus does not shuffle it. The heads order the values for ties; whole texts are
fetched for the winners alone. A checksum beside each fingerprint, and the texts
that are fetched, show when two texts share a fingerprint; then whole texts are
counted instead. So the winners are always exact, and a distinct count is unless
two texts agree in 32 characters, 128 bits and checksum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from tabulon.functions.columns import as_text, col, type_of
from tabulon.plans.tallies import combined, summed

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
HEAD = 32
LISTED = 64  # best values of a column that are looked at; beyond it ties are told apart by more of their texts
KEYS = ("column_index", "whole", "fraction", "head", "a", "b")
LANES = {"whole": "long", "fraction": "double", "head": "string", "a": "long", "b": "long", "check": "long"}


def _fingerprint(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def _checksum(text: Column) -> Column:
    return F.crc32(text)


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, WHOLE):
        return "whole"
    return "fraction" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "text"


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns c0, c1, ...: numbers as they are, everything else as text."""
    return df.select(
        *[
            (as_text(df, n) if _kind(type_of(df, n)) == "text" else col(n)).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )


def _lanes(cells: DataFrame, index: int) -> dict[str, Column]:
    """The lanes of a cell that are not null for its type. Texts of more than ``HEAD`` bytes
    are told apart by their fingerprint."""
    cell = F.col(f"c{index}")
    kind = _kind(type_of(cells, f"c{index}"))
    if kind != "text":
        return {kind: cell.cast(LANES[kind])}
    long = F.octet_length(cell) > HEAD
    a, b = _fingerprint(cell)
    texts = {"head": F.when(long, F.substring(cell, 1, HEAD)).otherwise(cell)}
    texts |= {"a": F.when(long, a), "b": F.when(long, b), "check": F.when(long, _checksum(cell))}
    return {lane: value.cast(LANES[lane]) for lane, value in texts.items()}


def value_counts(df: DataFrame, names: Sequence[str], whole_texts: bool = False, rows: int | None = None) -> DataFrame:
    """(column_index, whole, fraction, head, a, b, count, clash).

    A null cell has all lanes null. ``a`` and ``b`` are set for long texts only;
    ``clash`` tells that two texts share them. ``whole_texts`` keeps every text in ``head``.
    ``rows`` of the table are counted when absent.
    """
    cells = _cells(df, names)
    if whole_texts:
        return _whole_counts(cells, len(names))
    lanes = [_lanes(cells, i) for i in range(len(names))]
    groups = [{lane: f"{lane}{i}" for lane in found} for i, found in enumerate(lanes)]
    flat = cells.select(*[value.alias(f"{lane}{i}") for i, found in enumerate(lanes) for lane, value in found.items()])
    rows = df.count() if rows is None else rows
    return summed(
        combined(flat, groups, LANES),
        KEYS,
        rows * len(names),
        F.sum("n").alias("count"),
        F.coalesce(F.min("check") != F.max("check"), F.lit(False)).alias("clash"),
    )


def _whole_counts(cells: DataFrame, size: int) -> DataFrame:
    """The same with whole texts as heads; these do not leave the JVM."""

    def lanes(index: int) -> Column:
        kind = _kind(type_of(cells, f"c{index}"))
        values = {kind if kind != "text" else "head": F.col(f"c{index}")}
        typed = [values.get(k, F.lit(None)).cast(LANES[k]).alias(k) for k in KEYS[1:]]
        return F.struct(F.lit(index).alias("column_index"), *typed)

    rows = cells.select(F.inline(F.array(*[lanes(i) for i in range(size)])))
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count"), F.lit(False).alias("clash"))


def _sizes(df: DataFrame, names: Sequence[str], size: Column, rows: int | None = None) -> dict[str, int]:
    """``size`` of the counts of each column; by whole texts where fingerprints clash."""
    for whole_texts in (False, True):
        counts = value_counts(df, names, whole_texts, rows).groupBy("column_index")
        found = counts.agg(size.alias("size"), F.max("clash").alias("clash")).collect()
        if not any(r["clash"] for r in found):
            break
    return {n: 0 for n in names} | {names[r["column_index"]]: r["size"] for r in found}


def distinct_and_top(
    df: DataFrame, names: Sequence[str], top_for: Sequence[str], k: int = 10, rows: int | None = None
) -> tuple[dict[str, int], dict[str, list[tuple[str | None, int]]]]:
    """Distinct counts (null counts as a value) and the ``k`` most frequent values.

    Columns without a ranking are only counted; the counts of the others are kept while
    both halves read them. ``rows`` of the table are counted when absent. Ties go to the smaller text, null first. A bounded number of
    rows per column comes back, and at most ``k`` whole texts.
    """
    plain, ranked = [n for n in names if n not in top_for], [n for n in names if n in top_for]
    distinct = _sizes(df, plain, F.count(F.lit(1)), rows) if plain else {}
    tops: dict[str, list] = {n: [] for n in top_for}
    if ranked:
        sizes, found = _ranked(df, ranked, k, False, rows) or _ranked(df, ranked, k, True, rows)
        distinct |= sizes
        tops |= found
    return {n: distinct[n] for n in names}, tops


def _place(row: Row) -> tuple:
    """Sort key of a value as far as its head tells; equal for texts that share count and head."""
    return -row["count"], row["head"] is not None, row["head"] or "", row["a"] is not None


def _ranked(
    df: DataFrame, names: Sequence[str], k: int, whole_texts: bool, total: int | None = None
) -> tuple[dict, dict] | None:
    """Distinct counts and best values; None if two texts share a fingerprint."""
    listed = max(LISTED, k + 1)
    counts = value_counts(df, names, whole_texts, total).persist()
    try:
        shown = F.coalesce(F.col("head"), F.col("whole").cast("string"), F.col("fraction").cast("string"))
        values = counts.select("column_index", shown.alias("head"), "a", "b", "count")
        order = Window.partitionBy("column_index").orderBy(
            F.col("count").desc(), F.col("head").asc_nulls_first(), F.col("a").isNotNull()
        )
        best = values.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= listed).drop("n")
        sizes = counts.groupBy("column_index").agg(F.count(F.lit(1)).alias("count"), F.max("clash").alias("clash"))
        none = F.lit(None)
        found = (
            best.withColumn("clash", none.cast("boolean"))
            .unionByName(
                sizes.withColumns({"head": none.cast("string"), "a": none.cast("long"), "b": none.cast("long")})
            )
            .collect()
        )
    finally:
        counts.unpersist()
    totals = [r for r in found if r["clash"] is not None]
    if any(r["clash"] for r in totals):
        return None

    tops: dict[str, list] = {n: [] for n in names}
    wanted = []  # (column_index, a, b, count) of long texts that may be among the best
    for index, name in enumerate(names):
        rows = sorted((r for r in found if r["column_index"] == index and r["clash"] is None), key=_place)
        kept = rows
        if len(rows) > k:
            last = _place(rows[k - 1])
            kept = [r for r in rows if _place(r) <= last]
            if len(rows) == listed and kept[-1] is rows[-1]:  # the tie may go on beyond what is listed
                tied = kept[-1]
                kept = [r for r in rows if _place(r) < last]
                smallest = _smallest(df, name, tied["count"], tied["head"], k - len(kept))
                wanted += [(index, a, b, tied["count"]) for a, b in smallest]
        tops[name] = [(r["head"], r["count"]) for r in kept if r["a"] is None]
        wanted += [(index, r["a"], r["b"], r["count"]) for r in kept if r["a"] is not None]
    if wanted:
        texts = _fetch(df, names, wanted, k)
        if any(r["clash"] for r in texts):
            return None
        for r in texts:
            tops[names[r["column_index"]]].append((r["text"], r["count"]))
    for name, values in tops.items():
        values.sort(key=lambda v: (-v[1], v[0] is not None, v[0] or ""))
        del values[k:]
    return {n: 0 for n in names} | {names[r["column_index"]]: r["count"] for r in totals}, tops


def _smallest(df: DataFrame, name: str, count: int, prefix: str, need: int) -> list[tuple[int, int]]:
    """Fingerprints among which the ``need`` smallest texts are that begin with ``prefix``
    and occur ``count`` times. Each pass looks at the next stretch of the texts alone."""
    cells = _cells(df, [name])
    text = F.col("c0")
    a, b = _fingerprint(text)
    listed = max(LISTED, need + 1)
    step, out = HEAD, []
    while True:
        step *= 8
        rows = (
            cells.filter(text.startswith(prefix) & (F.octet_length(text) > HEAD))
            .groupBy(F.substring(text, len(prefix) + 1, step).alias("rest"), a.alias("a"), b.alias("b"))
            .count()
            .filter(F.col("count") == count)
            .orderBy("rest")
            .limit(listed)
            .collect()
        )
        last = rows[min(need, len(rows)) - 1]["rest"]
        if len(rows) < listed or rows[-1]["rest"] != last:
            return out + [(r["a"], r["b"]) for r in rows if r["rest"] <= last]
        before = [r for r in rows if r["rest"] < last]
        out += [(r["a"], r["b"]) for r in before]
        need -= len(before)
        prefix += last


def _fetch(df: DataFrame, names: Sequence[str], wanted: list[tuple], k: int) -> list[Row]:
    """The ``k`` best texts of each column among the wanted fingerprints, with their exact
    counts. ``clash`` marks texts that are not alone behind theirs; those come first."""
    cells = _cells(df, names)
    parts = []
    for i in sorted({w[0] for w in wanted}):
        text = F.col(f"c{i}")
        a, b = _fingerprint(text)
        long = F.octet_length(text) > HEAD
        parts.append(
            F.struct(F.lit(i).alias("column_index"), F.when(long, a).alias("a"), F.when(long, b).alias("b"), text.alias("text"))
        )
    known = df.sparkSession.createDataFrame(wanted, "column_index int, a long, b long, expected long")
    texts = (
        cells.select(F.inline(F.array(*parts)))
        .join(F.broadcast(known), ["column_index", "a", "b"])
        .groupBy("column_index", "text", "expected")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("clash", F.col("count") != F.col("expected"))
    )
    order = Window.partitionBy("column_index").orderBy(F.col("clash").desc(), F.col("count").desc(), "text")
    return texts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect()


def distinct_non_null(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values per column."""
    if not names:
        return {}
    filled = F.col("whole").isNotNull() | F.col("fraction").isNotNull() | F.col("head").isNotNull()
    return _sizes(df, list(names), F.count_if(filled))
