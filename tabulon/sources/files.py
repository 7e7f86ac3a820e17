"""Delimited text, JSON and Parquet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col

WHOLE = r"^[+-]?\d{1,19}$"
FRACTION = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"
BOOLEAN = r"^(true|false)$"


def read_delimited(
    spark: SparkSession, path: str, sep: str, multiline: bool | None = None
) -> DataFrame:
    """Header row, types from all rows: a column is a number or boolean only if every cell is.

    Dates stay text. Files are split over tasks unless a quoted cell holds a line
    break; ``multiline=None`` finds that out by looking for a line whose quotes
    do not pair up.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multiline = spark.read.text(path).filter(quotes % 2 == 1).limit(1).count() > 0
    raw = spark.read.csv(
        path, sep=sep, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"', nullValue="",
        mode="PERMISSIVE",
    )
    return cast_inferred(raw)


def cast_inferred(raw: DataFrame) -> DataFrame:
    """Text columns cast to long, double or boolean where all cells fit, so no cell is lost."""
    if not raw.columns:
        return raw
    checks = []
    for i, n in enumerate(raw.columns):
        cell = col(n)
        for tag, pattern in (("w", WHOLE), ("f", FRACTION), ("b", BOOLEAN)):
            fits = cell.rlike(pattern)
            if tag == "w":
                fits = F.when(cell.isNotNull(), fits & cell.try_cast("long").isNotNull())
            checks.append(F.bool_and(fits).alias(f"{tag}{i}"))
    row = raw.agg(*checks).first()
    out = []
    for i, n in enumerate(raw.columns):
        if row[f"w{i}"]:
            value = _long(col(n))
        elif row[f"f{i}"]:
            value = _double(col(n))
        elif row[f"b{i}"]:
            value = F.when(col(n) == "true", True).when(col(n) == "false", False)
        else:
            value = col(n)
        out.append(value.alias(n))
    return raw.select(*out)


def _long(cell: Column) -> Column:
    return F.when(cell.rlike(WHOLE), cell.try_cast("long"))


def _double(cell: Column) -> Column:
    return F.when(cell.rlike(FRACTION), cell.try_cast("double"))


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(
    spark: SparkSession, path: str, nested: str = "string", lines: bool = False, nan_as_null: bool = True
) -> DataFrame:
    """An array of objects or one object per file; ``lines=True`` for one object per line.

    ``nested="string"`` turns objects and arrays into JSON text, ``"flatten"``
    turns objects into ``parent.child`` columns.
    """
    if nested not in ("string", "flatten"):
        raise AnalysisError("nested must be string or flatten")
    df = spark.read.json(path, multiLine=not lines)
    out: list[Column] = []

    def add(value: Column, name: str, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType) and nested == "flatten":
            for f in dtype.fields:
                add(value.getField(f.name), f"{name}.{f.name}", f.dataType)
        elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(value, {"ignoreNullFields": "false"}).alias(name))
        elif nan_as_null and isinstance(dtype, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(value), value).alias(name))
        else:
            out.append(value.alias(name))

    for f in df.schema.fields:
        add(col(f.name), f.name, f.dataType)
    return df.select(*out)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader chosen by the lower-cased extension; no extension means CSV. Options go to
    the reader, such as ``lines=True`` for JSON."""
    from tabulon.sources.sqlite import read_sqlite
    from tabulon.sources.xlsx import read_xlsx

    readers = {
        "csv": read_csv,
        "tsv": read_tsv,
        "parquet": read_parquet,
        "json": read_json,
        "xlsx": read_xlsx,
        "db": read_sqlite,
        "sqlite": read_sqlite,
        "sqlite3": read_sqlite,
    }
    name = os.path.basename(path.rstrip("/"))
    extension = name.rsplit(".", 1)[1].lower() if "." in name else "csv"
    if extension not in readers:
        raise AnalysisError(f"Unsupported format: {extension}")
    return readers[extension](spark, path, **options)
