"""Table profile: basic facts, per-column statistics, correlations, outliers.

``TableProfile`` runs each pass over the table at most once and shares the
result between the reports built on it. What reaches the driver is bounded by
the number of columns, never by rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, functions as F, types as T

from tabulon.functions.columns import TEMPORAL_TYPES, as_double, as_text, col, numeric_columns, string_columns, type_of
from tabulon.plans.correlations import Moments, pearson, summarise_with_edges
from tabulon.plans.duplicates import duplicate_rows
from tabulon.plans.layout import spread
from tabulon.plans.quantiles import exact_quantiles, fences, rows_below, sketch_probabilities
from tabulon.plans.results import result_frame, rounded
from tabulon.plans.value_counts import distinct_and_top

QUARTILES = (0.25, 0.5, 0.75)

# Bytes per cell of fixed-width types.
WIDTHS = {
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "boolean": 1,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


class TableProfile:
    """Everything the reports need to know about one table."""

    def __init__(self, df: DataFrame, order_by: list[str] | None = None, factor: float = 1.5):
        self.df = df
        self.spark = df.sparkSession
        self.order_by = order_by
        self.factor = factor
        self.names = df.columns
        self.numeric = numeric_columns(df)
        self.strings = string_columns(df)
        self._distinct: dict[str, int] = {}
        self._top: dict[str, list[tuple[str | None, int]]] = {}
        self._fences: dict[str, tuple[tuple, tuple]] = {}
        self._watched: dict[tuple, tuple | None] = {}

    @cached_property
    def rows(self) -> int:
        return self.df.count()

    @cached_property
    def work(self) -> DataFrame:
        """The table as the passes read it. A small table is spread over the cores
        and kept for the passes; ``close`` releases it."""
        wide = spread(self.df, self.rows)
        return self.df if wide is self.df else wide.persist()

    def close(self) -> None:
        if "work" in self.__dict__ and self.work is not self.df:
            self.work.unpersist()
            del self.__dict__["work"]

    def load(self, *names: str) -> None:
        """Run passes that do not need each other side by side: none of them alone keeps
        a cluster busy to its end. The counts come first, which also fills the cache."""
        if self.rows and self.scalars:
            with ThreadPoolExecutor(len(names)) as pool:
                list(pool.map(lambda n: getattr(self, n), names))

    def __enter__(self) -> TableProfile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def scalars(self) -> dict:
        """Row, value and byte counts in one aggregate."""
        aggs = {"rows": F.count(F.lit(1))}
        for i, n in enumerate(self.names):
            aggs[f"n{i}"] = F.count(col(n))
            if n in self.numeric or isinstance(type_of(self.df, n), (*TEMPORAL_TYPES, T.BooleanType)):
                aggs[f"same{i}"] = F.min(col(n)) == F.max(col(n))
            if self._width(n) is None:
                aggs[f"bytes{i}"] = F.sum(F.octet_length(as_text(self.df, n)))
        return self.work.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()

    def _width(self, name: str) -> int | None:
        dtype = type_of(self.df, name)
        if isinstance(dtype, T.DecimalType):
            return 16
        return WIDTHS.get(dtype.simpleString())

    @cached_property
    def non_null(self) -> dict[str, int]:
        return {n: self.scalars[f"n{i}"] for i, n in enumerate(self.names)}

    @cached_property
    def missing(self) -> dict[str, int]:
        return {n: self.rows - k for n, k in self.non_null.items()}

    def _load_values(self, wanted: list[str]) -> None:
        """Count the distinct values of the columns not counted yet, in one pass."""
        todo = [n for n in wanted if n not in self._distinct]
        if todo:
            others = [n for n in todo if n not in self.numeric]
            distinct, top = distinct_and_top(self.work, todo, others, rows=self.rows)
            self._distinct |= distinct
            self._top |= top

    @property
    def distinct(self) -> dict[str, int]:
        """Distinct values per column; null counts as one value."""
        self._load_values(self.names)
        return self._distinct

    @property
    def text_distinct(self) -> dict[str, int]:
        """The same for the text columns alone."""
        self._load_values(self.strings)
        return self._distinct

    @property
    def text_top(self) -> dict[str, list[tuple[str | None, int]]]:
        self._load_values(self.strings)
        return self._top

    @property
    def top(self) -> dict[str, list[tuple[str | None, int]]]:
        """The most frequent values of the non-numeric columns."""
        self._load_values([n for n in self.names if n not in self.numeric])
        return self._top

    @cached_property
    def constant(self) -> list[str]:
        """Columns with at most one distinct value, null counting as a value.

        Smallest and largest value decide where they exist; only text and nested
        columns need their distinct values counted.
        """
        out = []
        for i, n in enumerate(self.names):
            same = self.scalars.get(f"same{i}")
            if f"same{i}" not in self.scalars:
                self._load_values([m for j, m in enumerate(self.names) if f"same{j}" not in self.scalars])
                single = self._distinct[n] <= 1
            else:
                single = not self.non_null[n] or (bool(same) and not self.missing[n])
            if single:
                out.append(n)
        return out

    @cached_property
    def text_bytes(self) -> dict[str, int]:
        return {
            n: self.scalars[f"bytes{i}"] or 0
            for i, n in enumerate(self.names)
            if self._width(n) is None
        }

    @cached_property
    def memory_bytes(self) -> int:
        fixed = sum((self._width(n) or 0) * self.rows for n in self.names)
        return fixed + sum(self.text_bytes.values())

    @cached_property
    def quartiles(self) -> dict[str, dict[float, float | None]]:
        sketch = {}
        for i, n in enumerate(self.numeric):
            m = self.moments[n]
            edges = self._first[2][n]
            sketch |= {f"q{i}_n": m.n, f"q{i}_lo": m.low, f"q{i}_hi": m.high, f"q{i}_edges": edges}
            ends = fences(edges[0:2], edges[4:6], self.factor) if edges else None
            if ends:
                self._fences[n] = tuple((n, *end) for end in ends)
        self._watched |= {span: None for pair in self._fences.values() for span in pair}
        return exact_quantiles(self.work, self.numeric, QUARTILES, "midpoint", sketch, watch=self._watched)

    def _outside(self, name: str, lower: float, upper: float) -> int | None:
        """Rows beyond the fences from the pass that counted the quartiles, None if it left them open."""
        if name not in self._fences:
            return None
        low, high = self._fences[name]
        under = rows_below(lower, low, self._watched[low])
        upto = rows_below(upper, high, self._watched[high], or_equal=True)
        return None if under is None or upto is None else under + self.moments[name].n - upto

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.work, total=self.rows)

    @cached_property
    def _first(self) -> tuple[dict[str, Moments], dict[tuple[str, str], tuple], dict]:
        """Moments, pair products and the brackets of the quartiles, in one pass."""
        return summarise_with_edges(self.work, self.numeric, sketch_probabilities(QUARTILES))

    @property
    def moments(self) -> dict[str, Moments]:
        return self._first[0]

    @cached_property
    def correlations(self) -> dict[tuple[str, str], float | None]:
        """Pearson r of every numeric pair; None where undefined."""
        return {pair: pearson(s) for pair, s in self._first[1].items()}

    @cached_property
    def outlier_rows(self) -> list[dict]:
        found = []
        for n in self.numeric:
            q1, q3 = self.quartiles[n][0.25], self.quartiles[n][0.75]
            if q1 is None:
                continue
            iqr = q3 - q1
            found.append(
                {
                    "column": n,
                    "q1": q1,
                    "q3": q3,
                    "iqr": iqr,
                    "lower": q1 - self.factor * iqr,
                    "upper": q3 + self.factor * iqr,
                }
            )
        for f in found:
            f["count"] = self._outside(f["column"], f["lower"], f["upper"])
        still = [f for f in found if f["count"] is None]
        if still:
            counts = self.work.agg(
                *[
                    F.count_if(
                        (as_double(self.work, f["column"]) < F.lit(f["lower"]))
                        | (as_double(self.work, f["column"]) > F.lit(f["upper"]))
                    ).alias(f"o{i}")
                    for i, f in enumerate(still)
                ]
            ).first()
            for i, f in enumerate(still):
                f["count"] = counts[f"o{i}"]
        for f in found:
            f["percent"] = round(f["count"] / self.non_null[f["column"]] * 100, 2)
        return found

    def missing_percent(self, name: str) -> float:
        return round(self.missing[name] / self.rows * 100, 2) if self.rows else 0.0

    def skewness(self, name: str) -> float | None:
        return self.moments[name].skewness

    def number_stats(self, name: str) -> list[float | None]:
        """Mean, median, std, min, max, q1, q3 and skewness to four decimals."""
        if not self.non_null[name]:
            return [None] * 8
        m, q = self.moments[name], self.quartiles[name]
        mean, std, skew = m.mean, m.deviation, m.skewness
        if m.n < self.non_null[name]:  # NaN cells make these undefined
            mean = std = skew = math.nan
        return [rounded(v) for v in (mean, q[0.5], std, m.low, m.high, q[0.25], q[0.75], skew)]

    # Report frames

    def basic_info(self) -> DataFrame:
        return result_frame(
            self.spark,
            [
                (
                    self.rows,
                    len(self.names),
                    self.memory_bytes,
                    round(self.memory_bytes / (1024 * 1024), 2),
                    self.duplicates,
                    sum(self.missing.values()),
                    self.names,
                    dict(Counter(t for _, t in self.df.dtypes)),
                )
            ],
            "rows long, columns long, memory_usage_bytes long, memory_usage_mb double, "
            "duplicate_rows long, total_missing long, column_names array<string>, "
            "dtypes_summary map<string,long>",
        )

    def column_analysis(self) -> DataFrame:
        self.load("quartiles", "distinct")
        out = []
        for n, dtype in self.df.dtypes:
            stats = self.number_stats(n) if n in self.numeric else [None] * 8
            out.append(
                (
                    n,
                    dtype,
                    self.missing[n],
                    float(self.missing_percent(n)),
                    self.distinct[n],
                    n in self.numeric,
                    *stats,
                )
            )
        return result_frame(
            self.spark,
            out,
            "name string, dtype string, missing_count long, missing_percent double, unique_count long, "
            "is_numeric boolean, mean double, median double, std double, min double, max double, "
            "q1 double, q3 double, skewness double",
        )

    def top_values(self) -> DataFrame:
        rows = [
            (n, place, "None" if value is None else value, count)
            for n, values in self.top.items()
            for place, (value, count) in enumerate(values, 1)
        ]
        return result_frame(self.spark, rows, "column string, rank int, value string, count long")

    def correlation_matrix(self) -> DataFrame:
        """Long form of the full square; undefined values are 0, also on the diagonal."""
        rows = []
        for a in self.numeric:
            for b in self.numeric:
                if a == b:
                    r = 1.0 if self.moments[a].variance else 0.0
                else:
                    r = self.correlations.get((a, b), self.correlations.get((b, a))) or 0.0
                rows.append((a, b, rounded(r)))
        return result_frame(self.spark, rows, "column1 string, column2 string, correlation double")

    def outliers(self) -> DataFrame:
        rows = [
            (
                f["column"],
                f["count"],
                f["percent"],
                *[rounded(f[k]) for k in ("lower", "upper", "q1", "q3", "iqr")],
            )
            for f in self.outlier_rows
        ]
        return result_frame(
            self.spark,
            rows,
            "column string, outlier_count long, outlier_percent double, lower_bound double, "
            "upper_bound double, q1 double, q3 double, iqr double",
        )

    def ranked_correlations(self, min_abs: float = 0.0) -> DataFrame:
        """Upper-triangle pairs by |r| with strength and direction labels."""
        rows = []
        for (a, b), r in self.correlations.items():
            r = rounded(r or 0.0)
            if abs(r) >= min_abs:
                rows.append((a, b, r, strength(r), direction(r), abs(r) >= 0.7))
        rows.sort(key=lambda x: (-abs(x[2]), x[0], x[1]))
        return result_frame(
            self.spark,
            rows,
            "column1 string, column2 string, correlation double, strength string, direction string, strong boolean",
        )

    def outlier_summary(self) -> DataFrame:
        rows = [(f["column"], f["count"], f["percent"], severity(f["percent"])) for f in self.outlier_rows]
        total = sum(r[1] for r in rows)
        affected = sum(1 for r in rows if r[1] > 0)
        return result_frame(
            self.spark,
            [(*r, total, affected) for r in rows],
            "column string, outlier_count long, outlier_percent double, severity string, "
            "total_outliers long, columns_affected int",
        )


def strength(r: float) -> str:
    size = abs(r)
    if size >= 0.8:
        return "very strongly"
    if size >= 0.6:
        return "strongly"
    if size >= 0.4:
        return "moderately"
    return "weakly"


def direction(r: float) -> str:
    return "together" if r >= 0 else "opposite"


def severity(percent: float) -> str:
    if percent == 0:
        return "none"
    if percent < 2:
        return "low"
    if percent < 5:
        return "moderate"
    return "high"


@contextmanager
def profiled(table: DataFrame | TableProfile, **options) -> Iterator[TableProfile]:
    """The profile itself, or a temporary one over a frame."""
    if isinstance(table, TableProfile):
        yield table
        return
    with TableProfile(table, **options) as profile:
        yield profile


def basic_info(table) -> DataFrame:
    with profiled(table) as p:
        return p.basic_info()


def column_analysis(table) -> DataFrame:
    with profiled(table) as p:
        return p.column_analysis()


def top_values(table) -> DataFrame:
    with profiled(table) as p:
        return p.top_values()


def correlation_matrix(table) -> DataFrame:
    with profiled(table) as p:
        return p.correlation_matrix()


def detect_outliers(table, factor: float = 1.5) -> DataFrame:
    with profiled(table, factor=factor) as p:
        return p.outliers()


def ranked_correlations(table, min_abs: float = 0.0) -> DataFrame:
    with profiled(table) as p:
        return p.ranked_correlations(min_abs)


def outlier_summary(table) -> DataFrame:
    with profiled(table) as p:
        return p.outlier_summary()


def numeric_stats(table) -> DataFrame:
    """The numeric part of ``column_analysis`` alone, without the distinct counts."""
    with profiled(table) as p:
        rows = [(n, *p.number_stats(n)) for n in p.numeric]
        return result_frame(
            p.spark,
            rows,
            "name string, mean double, median double, std double, min double, max double, "
            "q1 double, q3 double, skewness double",
        )
