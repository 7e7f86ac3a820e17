"""A table of one or many SQLite files, read in row-id ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.errors import AnalysisError
from tabulon.sources.xlsx import expand

ROWS_PER_TASK = 200_000
EXACT = 1 << 53  # whole numbers beyond are not all doubles


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def first_table(path: str) -> str:
    connection = _connect(path)
    try:
        row = connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' LIMIT 1").fetchone()
    finally:
        connection.close()
    if row is None:
        raise AnalysisError("No tables found in SQLite database")
    return row[0]


def _columns(connection: sqlite3.Connection, table: str) -> list[str]:
    return [d[0] for d in connection.execute(f"SELECT * FROM {quoted(table)} LIMIT 0").description]


def _row_id(names: list[str]) -> str | None:
    """A name of the row id that no column has taken."""
    taken = {n.lower() for n in names}
    return next((n for n in ("rowid", "_rowid_", "oid") if n not in taken), None)


def _ranges(path: str, table: str | None, rows_per_task: int) -> list[tuple[str, int | None, int | None]]:
    """(path, low, high) of the tasks that read a table; without row ids one task reads it."""
    connection = _connect(path)
    try:
        name = table or first_table(path)
        row_id = _row_id(_columns(connection, name))
        low = high = None
        if row_id:
            try:
                low, high = connection.execute(f"SELECT min({row_id}), max({row_id}) FROM {quoted(name)}").fetchone()
            except sqlite3.OperationalError:
                pass
    finally:
        connection.close()
    if low is None:
        return [(path, None, None)]
    return [(path, start, min(high, start + rows_per_task - 1)) for start in range(low, high + 1, rows_per_task)]


def _select(connection: sqlite3.Connection, table: str, what: str, low: int | None, high: int | None) -> sqlite3.Cursor:
    query = f"SELECT {what} FROM {quoted(table)}"
    if low is None:
        return connection.execute(query)
    return connection.execute(f"{query} WHERE {_row_id(_columns(connection, table))} BETWEEN ? AND ?", (low, high))


def _kinds(table: str | None):
    """(file, path, low, high) to (file, place, name, kind): the kinds of cells of each column
    in a range of rows; kind is empty where a column has no cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, path, low, high in zip(batch["file"], batch["path"], batch["low"], batch["high"]):
                connection = _connect(path)
                try:
                    name = table or first_table(path)
                    names = _columns(connection, name)
                    kind = "CASE WHEN typeof({0}) = 'integer' AND {0} NOT BETWEEN -{1} AND {1} THEN 'large' ELSE typeof({0}) END"
                    what = "DISTINCT " + ", ".join(kind.format(quoted(n), EXACT) for n in names)
                    found: list[set[str]] = [set() for _ in names]
                    for row in _select(connection, name, what, *((int(low), int(high)) if low else (None, None))):
                        for kinds, value in zip(found, row):
                            kinds.add(value)
                finally:
                    connection.close()
                cells = [(file, i, n, k) for i, n in enumerate(names) for k in sorted(found[i] - {"null"}) or [""]]
                yield pd.DataFrame(cells, columns=["file", "place", "name", "kind"])

    return run


def _type(kinds: set[str]) -> T.DataType:
    """The type that holds all cells of a column."""
    if kinds and kinds <= {"integer", "large"}:
        return T.LongType()
    if kinds and kinds <= {"integer", "real"}:
        return T.DoubleType()
    return T.BinaryType() if kinds == {"blob"} else T.StringType()


def united_schema(spark: SparkSession, paths: Sequence[str], table: str | None, rows_per_task: int) -> T.StructType:
    """The columns of all files, those of earlier ones first, with types that hold all cells.
    Names that differ in case only are one column, as in SQLite."""
    # Row ids travel as text: pandas would make doubles of them where a range has none.
    ranges = [
        (i, path, *(None if x is None else str(x) for x in bounds)) for i, p in enumerate(paths) for path, *bounds in _ranges(p, table, rows_per_task)
    ]
    parts = spark.createDataFrame(ranges, "file int, path string, low string, high string").repartition(len(ranges))
    found = parts.mapInPandas(_kinds(table), "file int, place int, name string, kind string").distinct().collect()  # a few for each column and file
    names: dict[str, str] = {}
    kinds: dict[str, set[str]] = {}
    for r in sorted(found, key=lambda r: (r["file"], r["place"])):
        names.setdefault(r["name"].lower(), r["name"])
        kinds.setdefault(r["name"].lower(), set()).update({r["kind"]} - {""})
    return T.StructType([T.StructField(names[n], _type(k)) for n, k in kinds.items()])


class RangePartition(InputPartition):
    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


class TableReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str | None, schema: T.StructType, rows_per_task: int):
        self.paths, self.table, self.schema, self.rows_per_task = paths, table, schema, rows_per_task

    def partitions(self) -> Sequence[InputPartition]:
        return [RangePartition(*r) for path in self.paths for r in _ranges(path, self.table, self.rows_per_task)]

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        connection = _connect(partition.path)
        try:
            name = self.table or first_table(partition.path)
            # SQLite takes a quoted name that is no column for a text.
            held = {n.lower() for n in _columns(connection, name)}
            columns = ", ".join(quoted(f.name) if f.name.lower() in held else "NULL" for f in self.schema.fields)
            for row in _select(connection, name, columns, partition.low, partition.high):
                yield tuple(_fit(v, f.dataType) for v, f in zip(row, self.schema.fields))
        finally:
            connection.close()


def _fit(value, dtype: T.DataType):
    if value is None:
        return None
    if isinstance(dtype, T.LongType):
        return value if isinstance(value, int) else None
    if isinstance(dtype, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) else None
    if isinstance(dtype, T.BinaryType):
        return bytes(value) if isinstance(value, (bytes, bytearray)) else None
    return value if isinstance(value, str) else str(value)


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabulon_sqlite"

    def _paths(self) -> list[str]:
        return self.options["paths"].split("\n")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        size = int(self.options.get("rowspertask", ROWS_PER_TASK))
        return TableReader(self._paths(), self.options.get("table"), schema, size)


def read_sqlite(
    spark: SparkSession, paths: str | Sequence[str], table: str | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """A table (by default the first one) of each file, their columns united; a job reads all
    rows to find types that hold every cell. Tasks open the files: they must reach the paths."""
    found = expand(paths, "database")
    if table is None:
        first_table(found[0])  # raises before a job is started
    spark.dataSource.register(TableSource)
    schema = united_schema(spark, found, table, rows_per_task)
    reader = spark.read.format("tabulon_sqlite").schema(schema).option("paths", "\n".join(found)).option("rowspertask", rows_per_task)
    return (reader.option("table", table) if table else reader).load()
