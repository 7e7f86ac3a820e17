"""Turning text into dates and numbers; text that does not parse becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.columns import col, type_of

# Accepted date and timestamp layouts, tried in order.
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "yyyy/M/d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
]
ISO_STAMP = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_timestamp(value: Column) -> Column:
    """A timestamp without zone from text in one of the known layouts."""
    text = F.trim(value)
    attempts = [F.when(text.rlike(ISO_STAMP), text.try_cast("timestamp").cast("timestamp_ntz"))]
    for pattern, layout in DATE_LAYOUTS:
        parsed = F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")
        attempts.append(F.when(text.rlike(pattern), parsed))
    return F.coalesce(*attempts)


def parse_number(value: Column, strip_commas: bool = False) -> Column:
    """A double from plain decimal or scientific notation."""
    text = F.replace(value, F.lit(","), F.lit("")) if strip_commas else value
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Any date-like column as a timestamp without zone."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.TimestampNTZType):
        return col(name)
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        return col(name).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return parse_timestamp(col(name))
    return F.lit(None).cast("timestamp_ntz")
