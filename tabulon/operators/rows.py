"""Row access: projection, preview, sorting and formula-safe text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tabulon.errors import AnalysisError
from tabulon.functions.columns import as_text, col, is_numeric, pick, require, type_of

MAX_ROWS = 20_000
FORMULA_START = ("=", "+", "-", "@", "\t", "\r")


@dataclass
class RowPage:
    rows: DataFrame
    total_rows: int
    truncated: bool


def _first(df: DataFrame, n: int, order_by: Sequence[str] | None) -> DataFrame:
    ordered = df.orderBy(*[col(o) for o in order_by]) if order_by else df
    return ordered.limit(n)


def select_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limit: int = 5000,
    order_by: Sequence[str] | None = None,
) -> RowPage:
    """Up to ``limit`` rows of the requested columns, with the true row count."""
    if not 1 <= limit <= MAX_ROWS:
        raise AnalysisError(f"limit must be between 1 and {MAX_ROWS}")
    wanted = list(columns) if columns else df.columns
    require(df, *wanted)
    total = df.count()
    page = _first(df, limit, order_by).select(*[col(n) for n in wanted])
    return RowPage(page, total, total > limit)


def preview(df: DataFrame, n: int = 50, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first rows as text, null shown as an empty string."""
    page = _first(df, n, order_by)
    return page.select(*[F.coalesce(as_text(df, c), F.lit("")).alias(c) for c in df.columns])


def sort_rows(
    df: DataFrame, column: str, direction: str | None, limit: int = 100, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The first rows by one column, nulls last either way; no direction keeps the order."""
    if direction not in ("asc", "desc", None):
        raise AnalysisError("direction must be asc, desc or None")
    require(df, column)
    if direction is None:
        return df.limit(limit)
    key = col(column).asc_nulls_last() if direction == "asc" else col(column).desc_nulls_last()
    return df.orderBy(key, *[col(t) for t in tie_break]).limit(limit)


def _safe(text: str) -> str:
    return f"'{text}" if text.startswith(FORMULA_START) else text


def sanitize_formulas(df: DataFrame) -> DataFrame:
    """Quote text and column names that a spreadsheet would run as a formula."""
    out = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, T.StringType):
            value = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
        out.append(value.alias(_safe(f.name)))
    return df.select(*out)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, *columns)
    return pick(df, columns)


def numbers_as_text(df: DataFrame) -> DataFrame:
    """Every non-numeric, non-text column cast to text (JSON-safe cells)."""
    out = []
    for n in df.columns:
        dtype = type_of(df, n)
        plain = isinstance(dtype, (T.StringType, T.BooleanType)) or (
            is_numeric(dtype) and not isinstance(dtype, T.DecimalType)
        )
        out.append(col(n) if plain else as_text(df, n).alias(n))
    return df.select(*out)
