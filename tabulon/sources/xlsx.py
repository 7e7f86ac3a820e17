"""First sheet of each workbook, one task per workbook."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.errors import AnalysisError

# Built-in number formats that show dates or times.
DATE_FORMATS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
EPOCH = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook, links = _xml(book, "xl/workbook.xml"), _xml(book, "xl/_rels/workbook.xml.rels")
    if workbook is not None and links is not None:
        targets = {r.get("Id"): r.get("Target") for r in links}
        for node in workbook.iter():
            if _local(node.tag) == "sheet":
                wanted = next((v for k, v in node.attrib.items() if _local(k) == "id"), None)
                target = targets.get(wanted)
                if target:
                    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    root = _xml(book, "xl/sharedStrings.xml")
    if root is None:
        return []
    return ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return set()
    custom = set()
    styles: list[int] = []
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", ""))
            if re.search(r"[ymdhs]", code, re.IGNORECASE) and "0" not in code.replace("ss.0", ""):
                custom.add(int(node.get("numFmtId", -1)))
        if _local(node.tag) == "cellXfs":
            styles = [int(x.get("numFmtId", 0)) for x in node]
    return {i for i, f in enumerate(styles) if f in custom or f in DATE_FORMATS}


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def workbook_rows(path: str) -> Iterator[list]:
    """Rows of the first sheet as Python values, read as a stream."""
    with zipfile.ZipFile(path) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if _local(node.tag) != "row":
                    continue
                row: list = []
                for cell in node:
                    at = _column_index(cell.get("r", "")) if cell.get("r") else len(row)
                    row.extend([None] * (at - len(row)))
                    row.append(_cell(cell, strings, dates))
                node.clear()
                yield row


def _cell(cell, strings: list[str], dates: set[int]):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    text = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(text)]
    if kind == "str":
        return text
    if kind == "b":
        return text == "1"
    number = float(text)
    if int(cell.get("s", -1)) in dates:
        return EPOCH + timedelta(seconds=round(number * 86400))
    return int(number) if number.is_integer() and not re.search(r"[.eE]", text) else number


def _header(row: list) -> list[str]:
    seen: dict[str, int] = {}
    names = []
    for i, value in enumerate(row):
        name = f"Unnamed: {i}" if value is None else str(value)
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def _type(kinds: set[str]) -> T.DataType:
    """The type that holds all cells of a column, given the names of their Python types."""
    if kinds == {"bool"}:
        return T.BooleanType()
    if kinds == {"int"}:
        return T.LongType()
    if kinds and kinds <= {"int", "float"}:
        return T.DoubleType()
    if kinds == {"datetime"}:
        return T.TimestampNTZType()
    return T.StringType()


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, place, name, kind): the header of each workbook and the kinds of cells of each
    column, over all rows; kind is empty where a column has no cell."""
    for batch in batches:
        for file, path in zip(batch["file"], batch["path"]):
            rows = workbook_rows(path)
            names = _header(next(rows, []))
            found: list[set[str]] = [set() for _ in names]
            for row in rows:
                for kinds, value in zip(found, row):
                    if value is not None:
                        kinds.add(type(value).__name__)
            cells = [(file, i, n, kind) for i, n in enumerate(names) for kind in sorted(found[i]) or [""]]
            yield pd.DataFrame(cells, columns=["file", "place", "name", "kind"])


def united_schema(spark: SparkSession, paths: Sequence[str]) -> T.StructType:
    """The columns of all workbooks, those of earlier ones first, with types that hold all cells."""
    files = spark.createDataFrame(list(enumerate(paths)), "file int, path string").repartition(len(paths), "file")
    found = files.mapInPandas(_kinds, "file int, place int, name string, kind string").collect()  # a few for each column
    kinds: dict[str, set[str]] = {}
    for r in sorted(found, key=lambda r: (r["file"], r["place"])):
        kinds.setdefault(r["name"], set()).update({r["kind"]} - {""})
    return T.StructType([T.StructField(n, _type(k)) for n, k in kinds.items()])


def _fit(value, dtype: T.DataType):
    if value is None:
        return None
    if isinstance(dtype, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(dtype, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    wanted = {"LongType": int, "BooleanType": bool, "TimestampNTZType": datetime}[type(dtype).__name__]
    return value if type(value) is wanted else None


class WorkbookPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType):
        self.paths, self.schema = paths, schema

    def partitions(self) -> Sequence[InputPartition]:
        return [WorkbookPartition(p) for p in self.paths]

    def read(self, partition: WorkbookPartition) -> Iterator[tuple]:
        rows = workbook_rows(partition.path)
        names = _header(next(rows, []))
        place = {n: i for i, n in enumerate(names)}
        at = [place.get(f.name, -1) for f in self.schema.fields]
        for row in rows:
            if all(v is None for v in row):
                continue
            yield tuple(
                _fit(row[i] if 0 <= i < len(row) else None, f.dataType) for i, f in zip(at, self.schema.fields)
            )


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabulon_xlsx"

    def _paths(self) -> list[str]:
        return self.options["paths"].split("\n")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self._paths(), schema)


def expand(paths: str | Sequence[str], what: str) -> list[str]:
    """Files named directly, by pattern or by directory, on storage every task can reach."""
    found: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if os.path.isdir(path):
            found += sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")))
        else:
            found += sorted(glob.glob(path)) or [path]
    missing = [p for p in found if not os.path.exists(p)]
    if missing or not found:
        raise AnalysisError(f"No {what} at {missing or paths}")
    return found


def read_xlsx(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """First sheets of one or many workbooks, their columns united; a job reads all rows to
    find types that hold every cell. Tasks open the files: they must reach the paths."""
    spark.dataSource.register(WorkbookSource)
    files = expand(paths, "workbook")
    return spark.read.format("tabulon_xlsx").schema(united_schema(spark, files)).option("paths", "\n".join(files)).load()
