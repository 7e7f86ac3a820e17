"""Column lookup and type rules shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.errors import AnalysisError

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise AnalysisError(f"Column not found: {missing}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [n for n in names if not is_numeric(type_of(df, n))]
    if wrong:
        raise AnalysisError(f"Column must be numeric: {wrong}")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The requested columns that exist, in the requested order."""
    return [n for n in names if n in df.columns]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns: what the cleaning steps call missing."""
    if is_float(type_of(df, name)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null."""
    value = col(name).cast("double")
    if is_float(type_of(df, name)):
        return F.when(~F.isnan(col(name)), value)
    return value


def groupable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be a grouping key (maps as sorted entries)."""
    if isinstance(type_of(df, name), T.MapType):
        return F.array_sort(F.map_entries(col(name)))
    return col(name)


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row that keeps nulls in different columns apart.

    Maps count by their sorted entries; variants and maps inside other values do not count.
    """
    cells = []
    for f in df.schema.fields:
        inner = [f.dataType.keyType, f.dataType.valueType] if isinstance(f.dataType, T.MapType) else [f.dataType]
        if all(_hashable(t) for t in inner):
            cells.append(groupable(df, f.name))
    holes = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return F.xxhash64(holes, *cells)


def as_text(df: DataFrame, name: str) -> Column:
    """Display text of a value; null stays null."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.StringType):
        return col(name)
    if isinstance(dtype, T.BooleanType):
        return F.when(col(name), "True").when(~col(name), "False")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(groupable(df, name))
    if isinstance(dtype, T.BinaryType):
        return F.hex(col(name))
    return col(name).cast("string")


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project to the named columns so the scan reads nothing else."""
    return df.select(*[col(n) for n in dict.fromkeys(names)])
