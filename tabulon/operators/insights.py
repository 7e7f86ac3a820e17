"""Rule-based findings and cleaning suggestions on top of a profile."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tabulon.operators.profile import TableProfile, profiled
from tabulon.operators.types import datetime_rows, numeric_rows
from tabulon.plans.results import result_frame


def insight_rows(p: TableProfile) -> list[tuple]:
    """(rule, level, measure, columns) for each of the eight rules that applies."""
    out = []
    cells = p.rows * len(p.names)
    total_missing = sum(p.missing.values())
    missing = total_missing / cells * 100 if cells else 0.0
    level = "success" if missing == 0 else "info" if missing < 5 else "warning"
    out.append(("missing_cells", level, round(missing, 1), []))
    duplicate = p.duplicates / p.rows * 100 if p.duplicates else 0.0
    out.append(("duplicate_rows", "warning" if p.duplicates else "success", round(duplicate, 1), []))
    sparse = [n for n in p.names if p.missing_percent(n) > 30]
    if sparse:
        out.append(("sparse_columns", "danger", float(len(sparse)), sparse))
    skewed = [n for n in p.numeric if abs(round(p.skewness(n) or 0.0, 4)) > 2]
    if skewed:
        out.append(("skewed_columns", "info", float(len(skewed)), skewed))
    heavy = [f["column"] for f in p.outlier_rows if f["percent"] > 5]
    if heavy:
        out.append(("outlier_columns", "warning", float(len(heavy)), heavy))
    elif p.outlier_rows:
        out.append(("outlier_columns", "success", 0.0, []))
    few = [n for n in p.numeric if p.distinct[n] <= 10]
    if few:
        out.append(("low_cardinality_numbers", "info", float(len(few)), few))
    constant = p.constant
    if constant:
        out.append(("constant_columns", "danger", float(len(constant)), constant))
    megabytes = round(p.memory_bytes / (1024 * 1024), 2)
    if megabytes > 100:
        out.append(("large_table", "info", megabytes, []))
    return out


def insights(table) -> DataFrame:
    with profiled(table) as p:
        return result_frame(p.spark, insight_rows(p), "rule string, level string, measure double, columns array<string>")


def suggestion_rows(p: TableProfile) -> list[tuple]:
    """All suggestions, the most urgent kinds first; callers may cut the list."""
    out = []

    def add(key, priority, category, column, title, affected, body):
        out.append((len(out) + 1, key, priority, category, column, title, affected, json.dumps(body)))

    if p.duplicates > 0:
        percent = round(p.duplicates / (p.rows or 1) * 100, 1)
        add(
            "remove-duplicates", "high" if percent > 5 else "medium", "duplicates", None,
            f"Remove {p.duplicates:,} duplicate rows ({percent}%)", p.duplicates, {"remove_duplicates": True},
        )
    sparse = sorted((n for n in p.names if p.missing_percent(n) > 5), key=lambda n: -p.missing_percent(n))
    for n in sparse:
        kind, action = ("numeric", "mean") if n in p.numeric else ("categorical", "mode")
        add(
            f"impute-{n}", "high" if p.missing_percent(n) > 30 else "medium", "missing_data", n,
            f"Fill {p.missing_percent(n):.0f}% missing values of {n} with the {action}", p.missing[n],
            {f"impute_{kind}": action, f"impute_{kind}_columns": [n]},
        )
    for f in sorted(p.outlier_rows, key=lambda f: -f["percent"]):
        if f["percent"] > 3:
            add(
                f"cap-outliers-{f['column']}", "medium", "outliers", f["column"],
                f"Cap outliers of {f['column']} ({f['percent']:.1f}% affected)", f["count"],
                {"cap_outliers": True, "outlier_columns": [f["column"]]},
            )
    for n, *_ in datetime_rows(p):
        add(f"cast-datetime-{n}", "low", "type_cast", n, f"Convert {n} to datetime", None, {"cast_datetime": [n]})
    for n, _, kind, *_ in numeric_rows(p):
        add(f"cast-numeric-{n}", "low", "type_cast", n, f"Convert {n} to {kind}", None, {"cast_numeric": [n]})
    return out


def cleaning_suggestions(table) -> DataFrame:
    with profiled(table) as p:
        return result_frame(
            p.spark,
            suggestion_rows(p),
            "rank int, id string, priority string, category string, column string, title string, "
            "estimated_rows_affected long, operation string",
        )


def apply_suggestions(df: DataFrame, rows, order_by=None) -> DataFrame:
    """Run the ``operation`` of each suggestion, in rank order, as cleaning steps.

    ``rows`` is a suggestions frame or a list of operation bodies (dict or JSON).
    """
    from tabulon.operators.clean import Cleaner

    if isinstance(rows, DataFrame):
        rows = [r["operation"] for r in rows.orderBy("rank").collect()]  # some for each column
    cleaner = Cleaner(df, order_by=order_by)
    for body in rows:
        cleaner = cleaner.apply(json.loads(body) if isinstance(body, str) else body)
    return cleaner.df
