"""Feature engineering: new columns next to the old ones, named by a suffix."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import as_double, col, present, require
from tabulon.functions.parsing import as_timestamp
from tabulon.operators.encode import code_column
from tabulon.plans import ordered
from tabulon.plans.quantiles import exact_quantiles
from tabulon.plans.results import result_frame


class Features:
    """Immutable chain like ``Cleaner``; columns that do not exist are skipped."""

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str] | None = None,
        partition_by: Sequence[str] = (),
        log: tuple[str, ...] = (),
        original: Sequence[str] | None = None,
    ):
        self.df = df
        self.order_by = list(order_by or [])
        self.partition_by = list(partition_by)
        self.log = log
        self.original = list(df.columns if original is None else original)

    def _next(self, df: DataFrame, entry: str) -> Features:
        return Features(df, self.order_by, self.partition_by, (*self.log, entry), self.original)

    def _add(self, columns: dict, entry: str) -> Features:
        return self._next(self.df.withColumns(columns) if columns else self.df, entry)

    def _order(self, order_by: Sequence[str] | None) -> list[str]:
        order = list(order_by or self.order_by)
        if not order:
            raise AnalysisError("This step depends on row order: give order_by")
        require(self.df, *order)
        return order

    def _ranges(self, names: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
        if not names:
            return {}
        aggs = []
        for i, n in enumerate(names):
            v = as_double(self.df, n)
            aggs += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        row = self.df.agg(*aggs).first()
        return {n: (row[f"l{i}"], row[f"h{i}"]) for i, n in enumerate(names)}

    def log_transform(self, columns: Sequence[str], handle_zeros: bool = True) -> Features:
        """``log1p`` after shifting non-positive columns above zero, or plain ``ln``."""
        names = present(self.df, columns)
        out = {}
        if not handle_zeros:
            for n in names:
                v = as_double(self.df, n)
                out[f"{n}_log"] = F.when(v == 0, F.lit(float("-inf"))).when(v > 0, F.ln(v))
            return self._add(out, f"log_transform {names}")
        for n, (low, _) in self._ranges(names).items():
            shift = abs(low) + 1 if low is not None and low <= 0 else 0.0
            out[f"{n}_log"] = F.log1p(as_double(self.df, n) + F.lit(shift))
        return self._add(out, f"log_transform {names}")

    def normalize_minmax(self, columns: Sequence[str]) -> Features:
        names = present(self.df, columns)
        out = {}
        for n, (low, high) in self._ranges(names).items():
            if low is None:
                out[f"{n}_norm"] = F.lit(None).cast("double")
            elif low == high:
                out[f"{n}_norm"] = F.lit(0.0)
            else:
                out[f"{n}_norm"] = (as_double(self.df, n) - F.lit(low)) / F.lit(high - low)
        return self._add(out, f"normalize_minmax {names}")

    def standardize_zscore(self, columns: Sequence[str]) -> Features:
        names = present(self.df, columns)
        if not names:
            return self
        aggs = []
        for i, n in enumerate(names):
            v = as_double(self.df, n)
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
        row = self.df.agg(*aggs).first()
        out = {}
        for i, n in enumerate(names):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            if std == 0:
                out[f"{n}_std"] = F.lit(0.0)
            elif std is None:
                out[f"{n}_std"] = F.lit(None).cast("double")
            else:
                out[f"{n}_std"] = (as_double(self.df, n) - F.lit(mean)) / F.lit(std)
        return self._add(out, f"standardize_zscore {names}")

    def bin_equal_width(self, column: str, n_bins: int = 5, labels: Sequence[str] | None = None) -> Features:
        """Right-closed bins of equal width; the lowest edge is moved down a little."""
        if column not in self.df.columns:
            return self
        if n_bins < 1 or (labels is not None and len(labels) != n_bins):
            raise AnalysisError("labels must be as many as bins")
        low, high = self._ranges([column])[column]
        name = f"{column}_bin"
        if low is None:
            return self._add({name: F.lit(None).cast("string")}, f"bin_equal_width {column}")
        edges = width_edges(low, high, n_bins)
        shown = list(labels) if labels is not None else interval_labels(edges)
        v = as_double(self.df, column)
        chosen = F.when(v <= F.lit(edges[0]), F.lit(None).cast("string"))
        for edge, label in zip(edges[1:], shown):
            chosen = chosen.when(v <= F.lit(edge), F.lit(label))
        return self._add({name: chosen}, f"bin_equal_width {column} into {n_bins}")

    def bin_equal_frequency(self, column: str, n_bins: int = 5) -> Features:
        """Quantile bins as 0-based codes; equal edges are merged."""
        if column not in self.df.columns:
            return self
        probs = [float(p) for p in np.linspace(0, 1, n_bins + 1)]
        found = exact_quantiles(self.df, [column], probs)[column]
        edges = sorted({found[p] for p in probs if found[p] is not None})
        name = f"{column}_qbin"
        if len(edges) < 2:
            return self._add({name: F.lit(None).cast("int")}, f"bin_equal_frequency {column}")
        v = as_double(self.df, column)
        code = F.lit(0)
        for edge in edges[1:-1]:
            code = code + F.when(v > F.lit(edge), 1).otherwise(0)
        return self._add({name: F.when(v.isNotNull(), code)}, f"bin_equal_frequency {column} at {edges}")

    def one_hot_encode(self, columns: Sequence[str], max_cardinality: int = 20) -> Features:
        """One boolean per value in order; null is false everywhere."""
        step = self
        for n in present(self.df, columns):
            found = self.df.select(col(n).alias("v")).filter(F.col("v").isNotNull()).distinct()
            values = [r["v"] for r in found.limit(max_cardinality + 1).collect()]
            if len(values) > max_cardinality:
                step = step._next(step.df, f"one_hot_encode skipped {n}: more than {max_cardinality} values")
                continue
            out = {f"{n}_{v}": F.coalesce(col(n) == F.lit(v), F.lit(False)) for v in sorted(values)}
            step = step._add(out, f"one_hot_encode {n} -> {list(out)}")
        return step

    def label_encode(self, columns: Sequence[str], rows_per_task: int = ordered.ROWS_PER_TASK) -> Features:
        """Codes from 0 over the sorted values; null is -1."""
        df = self.df
        names = present(df, columns)
        for n in names:
            df = code_column(df, n, f"{n}_enc", rows_per_task=rows_per_task)
        return self._next(df, f"label_encode {names}")

    def extract_datetime_features(self, columns: Sequence[str]) -> Features:
        out = {}
        names = present(self.df, columns)
        for n in names:
            t = as_timestamp(self.df, n)
            out |= {
                f"{n}_year": F.year(t),
                f"{n}_month": F.month(t),
                f"{n}_day": F.dayofmonth(t),
                f"{n}_dayofweek": F.weekday(t),
                f"{n}_hour": F.hour(t),
            }
        return self._add(out, f"extract_datetime_features {names}")

    def interaction_product(self, first: str, second: str) -> Features:
        if first not in self.df.columns or second not in self.df.columns:
            return self
        return self._add({f"{first}_x_{second}": col(first) * col(second)}, f"{first} x {second}")

    def interaction_ratio(self, first: str, second: str) -> Features:
        """Zero denominators give null."""
        if first not in self.df.columns or second not in self.df.columns:
            return self
        ratio = F.try_divide(col(first).cast("double"), col(second).cast("double"))
        return self._add({f"{first}_div_{second}": ratio}, f"{first} / {second}")

    def rolling_stats(
        self,
        column: str,
        window: int = 3,
        order_by: Sequence[str] | None = None,
        partition_by: Sequence[str] | None = None,
        rows_per_task: int = ordered.ROWS_PER_TASK,
    ) -> Features:
        """Mean and sample deviation over the last ``window`` rows."""
        if column not in self.df.columns:
            return self
        order = self._order(order_by)
        groups = list(self.partition_by if partition_by is None else partition_by)
        total = ordered.largest_group(self.df, groups)
        rows = total if not groups else self.df.count()
        width = max(2, min(window, rows))
        v = as_double(self.df, column)

        def build(spec):
            frame = spec.rowsBetween(1 - width, 0)
            return {
                f"{column}_roll_mean_{width}": F.avg(v).over(frame),
                f"{column}_roll_std_{width}": F.stddev_samp(v).over(frame),
            }

        rolled = ordered.sliding(
            self.df, build, order, groups, before=width - 1, total=total, rows_per_task=rows_per_task
        )
        return self._next(rolled, f"rolling_stats {column} over {width}")

    def lag_features(
        self,
        column: str,
        lags: Sequence[int] = (1, 2, 3),
        order_by: Sequence[str] | None = None,
        partition_by: Sequence[str] | None = None,
        rows_per_task: int = ordered.ROWS_PER_TASK,
    ) -> Features:
        if column not in self.df.columns:
            return self
        order = self._order(order_by)
        groups = list(self.partition_by if partition_by is None else partition_by)

        def build(spec):
            return {f"{column}_lag{k}": F.lag(col(column), k).over(spec) for k in lags}

        back = max(0, *lags)
        ahead = max(0, *(-k for k in lags))
        shifted = ordered.sliding(
            self.df, build, order, groups, before=back, after=ahead, rows_per_task=rows_per_task
        )
        return self._next(shifted, f"lag_features {column} by {list(lags)}")

    def summary(self) -> DataFrame:
        new = [n for n in self.df.columns if n not in self.original]
        return result_frame(
            self.df.sparkSession,
            [(new, len(self.df.columns), list(self.log))],
            "new_columns array<string>, total_columns long, transform_log array<string>",
        )


def width_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal-width right-closed bins that take in the lowest value."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        return [float(e) for e in np.linspace(low - pad, high + pad, bins + 1)]
    edges = [float(e) for e in np.linspace(low, high, bins + 1)]
    edges[0] -= 0.001 * (high - low)
    return edges


def interval_labels(edges: Sequence[float]) -> list[str]:
    """``(a, b]`` with three significant decimals, more where edges would collide."""
    for precision in range(3, 20):
        shown = [_short(e, precision) for e in edges]
        if len(set(shown)) == len(shown):
            break
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def _short(value: float, precision: int) -> float:
    if value == 0 or not math.isfinite(value):
        return value
    digits = precision
    if abs(value) < 1:
        digits = precision - 1 - math.floor(math.log10(abs(value)))
    return round(value, digits)
