"""The aggregated data behind each chart. Results are bounded by bins, buckets or top-n."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulon.errors import AnalysisError
from tabulon.functions.columns import (
    as_double,
    as_text,
    col,
    groupable,
    is_missing,
    is_numeric,
    numeric_columns,
    require,
    require_numeric,
    type_of,
)
from tabulon.functions.parsing import as_timestamp
from tabulon.operators.quality import quality_radar
from tabulon.operators.types import detect_date_column
from tabulon.plans.correlations import pair_statistics, pearson
from tabulon.plans.ordered import ROWS_PER_TASK, with_positions
from tabulon.plans.quantiles import exact_quantiles, grouped_quantiles
from tabulon.plans.results import result_frame
from tabulon.plans.value_counts import distinct_non_null

BINS = 30
KDE_CELL = 0.5  # width of a cell in bandwidths: rows lie within a quarter of one from the middle
KDE_TERMS = 12  # the terms beyond add less than 0.25^12 / sqrt(12!) of a kernel's height
KDE_REACH = 9  # bandwidths beyond which a kernel is below 1e-17 of its height
AGGREGATES = ("sum", "mean", "count", "max", "min", "median")


def _moments(df: DataFrame, column: str) -> dict:
    require_numeric(df, column)
    v = as_double(df, column)
    row = df.agg(
        F.count(v).alias("n"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
    ).first()
    if not row["n"]:
        raise AnalysisError(f"Column {column!r} is empty")
    return row.asDict()


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins over the finite values, the last one closed, with the column's mean
    and median and the number of infinite values."""
    m = _moments(df, column)
    every_value = as_double(df, column)
    v = F.when(F.abs(every_value) < F.lit(math.inf), every_value)
    seen = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(every_value).alias("n"), F.count(v).alias("finite")).first()
    low, high = seen["low"], seen["high"]
    if low is None:
        raise AnalysisError(f"Column {column!r} has no finite value")
    width = (high - low) / bins
    median = exact_quantiles(df, [column], [0.5])[column][0.5]
    place = F.lit(0) if width == 0 else F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = df.filter(v.isNotNull()).groupBy(place.cast("int").alias("bin")).count()
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.lit(m["mean"]).alias("mean"),
        F.lit(median).alias("median"),
        F.lit(seen["n"] - seen["finite"]).cast("long").alias("infinite"),
    )


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density with Scott's bandwidth, also scaled to a 30-bin histogram.

    A fast Gauss transform: rows add up to moments of cells half a bandwidth wide, and the
    kernels of a cell are a polynomial in the distance from its middle. A row costs the same
    for any number of points, and the density is off by less than 1e-11 of a kernel's height.
    A constant column, or one with infinite values, has no density and gives no rows.
    """
    m = _moments(df, column)
    n, low, high, std = m["n"], m["low"], m["high"], m["std"]
    if not std or not math.isfinite(std):
        return result_frame(df.sparkSession, [], "point int, x double, density double, scaled double")
    width = n ** (-1 / 5) * std
    grid = np.linspace(low, high, points)

    cells = df.select(as_double(df, column).alias("v")).filter(F.col("v").isNotNull())
    cells = cells.withColumn("cell", F.floor((F.col("v") - F.lit(low)) / F.lit(width * KDE_CELL)))
    middle = F.lit(low) + (F.col("cell") + 0.5) * F.lit(width * KDE_CELL)
    moments = cells.withColumn("t", (F.col("v") - middle) / F.lit(width)).groupBy("cell").agg(
        F.count(F.lit(1)).cast("double").alias("m0"),
        *[F.sum(math.prod([F.col("t")] * k)).alias(f"m{k}") for k in range(1, KDE_TERMS)],
    )
    # exp(-(u - t)^2 / 2) = exp(-u^2 / 2) * sum of He_k(u) * t^k / k!, by powers of u.
    powers = [
        sum(F.lit(c / math.factorial(k)) * F.col(f"m{k}") for k, c in enumerate(column_of) if c).alias(f"c{j}")
        for j, column_of in enumerate(zip(*_hermite(KDE_TERMS), strict=True))
    ]
    at = F.posexplode(F.array(*[F.lit(float(x)) for x in grid])).alias("point", "x")
    u = (F.col("x") - F.col("middle")) / F.lit(width)
    near = moments.select(middle.alias("middle"), *powers).select("*", at).withColumn("u", u).filter(F.abs("u") <= KDE_REACH)
    kernels = F.col(f"c{KDE_TERMS - 1}")
    for j in reversed(range(KDE_TERMS - 1)):
        kernels = kernels * F.col("u") + F.col(f"c{j}")
    sums = near.groupBy("point").agg(F.sum(F.exp(F.col("u") * F.col("u") * -0.5) * kernels).alias("total"))
    # A point between far outliers may have no cell near it.
    every = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "point int, x double")
    total = F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0))
    density = total / F.lit(n * width * math.sqrt(2 * math.pi))
    return every.join(F.broadcast(sums), "point", "left").select(
        "point", "x", density.alias("density"), (density * F.lit(n * (high - low) / BINS)).alias("scaled")
    )


def _hermite(count: int) -> list[list[int]]:
    """Coefficients of He_0, He_1, ... by power: He_k+1(u) = u * He_k(u) - k * He_k-1(u)."""
    rows = [[1] + [0] * (count - 1)]
    for k in range(count - 1):
        before = rows[k - 1] if k else [0] * count
        rows.append([(rows[k][j - 1] if j else 0) - k * before[j] for j in range(count)])
    return rows


def box_stats(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Linear quartiles, fences, whisker ends and the number of points outside."""
    m = _moments(df, column)
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    iqr = q[0.75] - q[0.25]
    low, high = q[0.25] - factor * iqr, q[0.75] + factor * iqr
    v = as_double(df, column)
    inside = v.between(low, high)
    return df.agg(
        F.lit(column).alias("column"),
        F.lit(q[0.25]).alias("q1"),
        F.lit(q[0.5]).alias("median"),
        F.lit(q[0.75]).alias("q3"),
        F.lit(m["mean"]).alias("mean"),
        F.lit(low).alias("lower_fence"),
        F.lit(high).alias("upper_fence"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outlier_count"),
    )


def box_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """The points outside the fences, left distributed."""
    require_numeric(df, column)
    q = exact_quantiles(df, [column], [0.25, 0.75])[column]
    if q[0.25] is None:
        raise AnalysisError(f"Column {column!r} is empty")
    reach = factor * (q[0.75] - q[0.25])
    v = as_double(df, column)
    return df.select(v.alias(column)).filter(~col(column).between(q[0.25] - reach, q[0.75] + reach))


def category_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Most frequent non-null values with their share of the non-null rows."""
    require(df, column)
    total = df.agg(F.count(col(column))).first()[0]
    if not total:
        raise AnalysisError(f"Column {column!r} is empty")
    value = as_text(df, column)
    counts = df.filter(~is_missing(df, column)).groupBy(value.alias("value")).count()
    top = counts.orderBy(F.col("count").desc(), "value").limit(top_n)
    return top.withColumn("percent", F.round(F.col("count") / F.lit(total) * 100, 1))


def missing_matrix(
    df: DataFrame, order_by: Sequence[str], rows_per_task: int = ROWS_PER_TASK, points: int = 200
) -> DataFrame:
    """Missing-cell indicators of columns with gaps, every ``n // points``-th row by order:
    the picture has about so many lines."""
    require(df, *order_by)
    aggs = [F.count_if(is_missing(df, n)).alias(f"m{i}") for i, n in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    gaps = [n for i, n in enumerate(df.columns) if row[f"m{i}"]]
    if not gaps:
        raise AnalysisError("No missing data found")
    step = max(1, row["n"] // points)
    slim = df.select(
        *[col(o).alias(f"__o{i}") for i, o in enumerate(order_by)],
        *[is_missing(df, n).cast("int").alias(n) for n in gaps],
    )
    placed = with_positions(slim, [f"__o{i}" for i in range(len(order_by))], name="row_index", total=row["n"], rows_per_task=rows_per_task)
    picked = placed.withColumn("row_index", F.col("row_index") - 1).filter(F.col("row_index") % step == 0)
    return picked.select("row_index", *[col(n) for n in gaps])


def _category_totals(df: DataFrame, category: str, value: str | None) -> tuple[DataFrame, Column]:
    """Rows with a category, and the aggregate that measures them."""
    require(df, category)
    rows = df.filter(~is_missing(df, category))
    if value is None:
        return rows, F.count(F.lit(1)).cast("double")
    require_numeric(df, value)
    return rows, F.coalesce(F.sum(as_double(df, value)), F.lit(0.0))


def _head_and_other(rows, category, measure, order, top_n) -> tuple[list[tuple[str, float]], bool]:
    """The leading categories, and the rest folded into Other when it is not zero."""
    grouped = rows.groupBy(col(category).alias("c")).agg(measure.alias("v"))
    head = grouped.orderBy(order(F.col("v")).desc(), F.col("c")).limit(top_n + 1).collect()
    if not head:
        raise AnalysisError("No data to chart")
    if len(head) <= top_n:
        return [(str(r["c"]), r["v"]) for r in head], False
    head = head[:top_n]
    rest = rows.filter(~col(category).isin([r["c"] for r in head])).agg(measure.alias("v")).first()["v"]
    out = [(str(r["c"]), r["v"]) for r in head]
    return (out + [("Other", rest)], True) if rest else (out, False)


def pareto(df: DataFrame, category: str, value: str | None = None, top_n: int = 15) -> DataFrame:
    """Categories by size with the running share of the grand total."""
    rows, measure = _category_totals(df, category, value)
    head, _ = _head_and_other(rows, category, measure, lambda v: v, top_n)
    total = rows.agg(measure.alias("v")).first()["v"]
    if not total:
        raise AnalysisError("All values are zero, nothing to rank")
    out, running = [], 0.0
    for rank, (label, size) in enumerate(head, 1):
        running += size
        out.append((rank, label, float(size), running / total * 100))
    return result_frame(df.sparkSession, out, "rank int, category string, value double, cumulative_percent double")


def waterfall(df: DataFrame, category: str, value: str, top_n: int = 12) -> DataFrame:
    """Signed contributions by absolute size, then the total."""
    rows, measure = _category_totals(df, category, value)
    head, _ = _head_and_other(rows, category, measure, F.abs, top_n)
    total = rows.agg(measure.alias("v")).first()["v"]
    out = [(i, label, float(size), "relative") for i, (label, size) in enumerate(head, 1)]
    out.append((len(out) + 1, "Total", float(total), "total"))
    return result_frame(df.sparkSession, out, "rank int, category string, value double, measure string")


def _aggregate(agg: str, v: Column) -> Column:
    return {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[agg](v).cast("double")


def _grouped(df: DataFrame, group: str, value: str, agg: str) -> DataFrame:
    if agg == "median":
        found = grouped_quantiles(df, [group], value, [0.5], ["value"])
        return found.select(col(group), "value")
    if agg == "count":
        measure = F.count_if(~is_missing(df, value)).cast("double")
    elif agg == "sum":
        measure = F.coalesce(_aggregate(agg, as_double(df, value)), F.lit(0.0))
    else:
        measure = _aggregate(agg, as_double(df, value))
    return df.groupBy(col(group)).agg(measure.alias("value"))


def top_n(
    df: DataFrame,
    category: str,
    value: str | None = None,
    agg: str = "sum",
    n: int = 10,
    ascending: bool = False,
) -> DataFrame:
    """Categories ranked by an aggregated measure; without a measure, by row count."""
    require(df, category)
    if agg not in AGGREGATES:
        raise AnalysisError(f"agg must be one of {sorted(AGGREGATES)}")
    if n < 1:
        raise AnalysisError("n must be positive")
    rows = df.filter(~is_missing(df, category))
    if value is None:
        grouped = rows.groupBy(col(category)).agg(F.count(F.lit(1)).cast("double").alias("value"))
    else:
        require(df, value)
        if agg != "count":
            require_numeric(df, value)
        grouped = _grouped(rows, category, value, agg)
    order = F.col("value").asc() if ascending else F.col("value").desc()
    ranked = grouped.filter(F.col("value").isNotNull()).orderBy(order, col(category)).limit(n)
    return ranked.select(col(category).cast("string").alias("category"), "value")


def trend_unit(span_days: int) -> str:
    if span_days <= 62:
        return "day"
    if span_days <= 365 * 2:
        return "week"
    if span_days <= 365 * 8:
        return "month"
    return "year"


def trend(df: DataFrame, date: str, value: str | None = None, agg: str = "sum") -> DataFrame:
    """A measure per day, week, month or year, whichever suits the span, with a
    rolling mean. Weeks carry the date of their Sunday. Empty buckets are zero
    for sums and counts and absent otherwise."""
    require(df, date)
    if is_numeric(type_of(df, date)):
        raise AnalysisError(f"Column {date!r} is numeric, not a date")
    if agg not in AGGREGATES:
        raise AnalysisError(f"agg must be one of {sorted(AGGREGATES)}")
    if value is not None:
        require_numeric(df, value)
    measured = F.lit(1.0) if value is None else as_double(df, value)
    if value is None:
        agg = "sum"
    dated = df.select(as_timestamp(df, date).alias("at"), measured.alias("v")).filter(F.col("at").isNotNull())
    seen = dated.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    if seen["n"] < 2:
        raise AnalysisError(f"Column {date!r} has fewer than 2 parseable dates")
    unit = trend_unit((seen["high"] - seen["low"]).days)
    start = F.date_trunc(unit, F.col("at")).cast("date")
    slim = dated.select(start.alias("start"), "v")
    buckets = _grouped(slim, "start", "v", agg)
    if agg in ("sum", "count"):
        edges = [F.date_trunc(unit, F.lit(seen[k].isoformat(sep=" ")).cast("timestamp_ntz")).cast("date") for k in ("low", "high")]
        every = df.sparkSession.range(1).select(
            F.explode(F.sequence(*edges, F.expr(f"interval 1 {unit}"))).alias("start")
        )
        buckets = every.join(F.broadcast(buckets), "start", "left").select(
            "start", F.coalesce("value", F.lit(0.0)).alias("value")
        )
    buckets = buckets.filter(F.col("value").isNotNull())
    label = F.date_add("start", 6) if unit == "week" else F.col("start")
    buckets = buckets.select(label.alias("bucket"), "value")
    n = buckets.count()
    if not n:
        raise AnalysisError("Not enough data to build a trend")
    rolling = F.lit(None).cast("double")
    if n >= 5:  # a calendar of buckets, at most a few thousand rows
        width = max(2, min(7, n // 4))
        rolling = F.avg("value").over(Window.orderBy("bucket").rowsBetween(1 - width, 0))
    return buckets.select("bucket", "value", rolling.alias("rolling_mean"), F.lit(unit).alias("unit"))


def scatter_matrix(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_cols: int = 4,
    points: int = 2000,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Complete rows of the named numeric columns, or of the ``max_cols`` with the largest
    variance, thinned to ``points`` by a hash of the row key so that the same points come
    back every time."""
    numeric = numeric_columns(df)
    if len(numeric) < 2:
        raise AnalysisError("Need at least 2 numeric columns for a scatter matrix")
    if max_cols < 2 or points < 1:
        raise AnalysisError("A scatter matrix needs at least 2 columns and 1 point")
    if columns:
        wrong = [c for c in columns if c not in numeric]
        if wrong:
            raise AnalysisError(f"Columns not found or not numeric: {wrong}")
        chosen = list(dict.fromkeys(columns))
    else:
        chosen = [n for n, _ in variance_ranking(df)][:max_cols]
    if len(chosen) < 2:
        raise AnalysisError("Need at least 2 numeric columns for a scatter matrix")
    complete = df
    for n in chosen:
        complete = complete.filter(~is_missing(df, n))
    order = F.md5(F.concat_ws(":", *[F.coalesce(as_text(df, k), F.lit("")) for k in (key or df.columns)], F.lit("42")))
    picked = complete.select(*[col(n) for n in chosen], order.alias("__h"))
    return picked.orderBy("__h", *[col(n) for n in chosen]).limit(points).drop("__h")


def variance_ranking(df: DataFrame) -> list[tuple[str, float]]:
    """Numeric columns with a variance, largest first."""
    numeric = numeric_columns(df)
    if not numeric:
        return []
    row = df.agg(*[F.var_samp(as_double(df, n)).alias(f"v{i}") for i, n in enumerate(numeric)]).first()
    found = [(n, row[f"v{i}"]) for i, n in enumerate(numeric) if row[f"v{i}"] is not None]
    return sorted(found, key=lambda p: -p[1])


def correlation_heatmap(df: DataFrame) -> DataFrame:
    """Strict upper triangle; undefined pairs stay null; strong pairs are marked."""
    numeric = numeric_columns(df)
    if len(numeric) < 2:
        raise AnalysisError("Need at least 2 numeric columns for correlation")
    rows = []
    for (a, b), s in pair_statistics(df, numeric).items():
        r = pearson(s)
        rows.append((a, b, r, r is not None and abs(r) > 0.7))
    return result_frame(df.sparkSession, rows, "column1 string, column2 string, correlation double, annotated boolean")


def auto_pick(df: DataFrame) -> DataFrame:
    """One row: the category and the value column that suit the ranking charts."""
    others = [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)
    ]
    near = {}
    if others:  # exact counts only where the estimate comes near the limit
        row = df.agg(*[F.approx_count_distinct(groupable(df, n)).alias(f"d{i}") for i, n in enumerate(others)]).first()
        near = {n for i, n in enumerate(others) if row[f"d{i}"] <= 100}
    distinct = distinct_non_null(df, [n for n in others if n in near])
    fitting = [(k, n) for n, k in distinct.items() if 2 <= k <= 50]
    category = max(fitting)[1] if fitting else None
    ranked = variance_ranking(df) if category else []
    return result_frame(df.sparkSession, [(category, ranked[0][0] if ranked else None)], "category string, value string")


def all_charts(df: DataFrame, order_by: Sequence[str] | None = None) -> dict:
    """Every chart the table has the columns for, as a dictionary of frames."""
    charts: dict = {}

    def offer(name: str, build) -> None:
        try:
            charts[name] = build()
        except AnalysisError:
            pass

    numeric = numeric_columns(df)
    offer("correlation_heatmap", lambda: correlation_heatmap(df))
    if order_by:
        offer("missing_data_matrix", lambda: missing_matrix(df, order_by))
    offer("quality_radar", lambda: quality_radar(df))
    if len(numeric) >= 3:
        offer("scatter_matrix", lambda: scatter_matrix(df))
    picked = auto_pick(df).first()
    category, value = picked["category"], picked["value"]
    if category is not None:
        offer("pareto", lambda: pareto(df, category, value))
        offer("top_n", lambda: top_n(df, category, value))
        if value is not None:
            offer("waterfall", lambda: waterfall(df, category, value))
    date = detect_date_column(df)
    if date is not None:
        offer("trend", lambda: trend(df, date, value))
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            offer(f"distribution:{f.name}", lambda n=f.name: histogram(df, n))
            offer(f"box_plot:{f.name}", lambda n=f.name: box_stats(df, n))
            offer(f"violin:{f.name}", lambda n=f.name: kde(df, n))
        else:
            offer(f"categorical_bar:{f.name}", lambda n=f.name: category_counts(df, n))
    return charts


def chart_catalog(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """(chart, rows) of every available chart."""
    rows = [(name, frame.count()) for name, frame in all_charts(df, order_by).items()]
    return result_frame(df.sparkSession, rows, "chart string, points long")
