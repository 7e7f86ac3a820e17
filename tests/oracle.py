"""Compare a Spark query with its SQL on DuckDB: columns, row count, values in any order."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tabulon.shipping import ship  # noqa: E402


def connect(folder: str):
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(canonical(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(v) for v in t)
    )


def compare(frame, connection, sql: str) -> str | None:
    """None when equal, else a short description."""
    left_columns, left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    right_columns, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} vs {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}: {left[:2]} vs {right[:2]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark, os.path.join(ROOT, "workload"))
    return spark


def main(names: list[str], folder: str) -> int:
    from workload import ORACLES, QUERIES

    spark, connection, failures = session(), connect(folder), 0
    for name, run in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in ORACLES:
                verdict = compare(frame, connection, ORACLES[name])
            else:
                verdict = None
                print(f"     {frame.count()} rows, no SQL")
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:400]}"
        failures += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name} {time.time() - start:.2f}s {verdict or ''}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:]
    where = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    sys.exit(1 if main(arguments, where) else 0)
