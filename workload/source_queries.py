"""Readers and writers, over files that Spark writes from the tables first."""

from __future__ import annotations

import os
import sqlite3
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from tabulon import sources
from tabulon.operators import compare
from workload.common import r, scratch, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


@query("read_parquet_part", f"SELECT p_partkey, p_name, p_brand, p_type, p_size, {r('p_retailprice', 2)} AS p_retailprice FROM part")
def read_parquet(spark, folder):
    return tidy(sources.read_any(spark, f"{folder}/part.parquet"), 2)


ORDER_TEXT = (
    "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, "
    + r("o_totalprice", 2)
    + " AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, o_totalprice > 200000 AS big FROM orders"
)


def order_text(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "nullif(o_orderstatus, 'P') AS o_orderstatus", "o_totalprice",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS o_orderdate", "o_orderpriority", "o_totalprice > 200000 AS big",
    )


@query("csv_round_trip", ORDER_TEXT)
def csv_round_trip(spark, folder):
    path = scratch(spark, "csv")
    sources.write_csv(order_text(spark, folder), path)
    return tidy(sources.read_csv(spark, path), 2)


@query("csv_with_line_breaks", "SELECT doc_id, text, lang FROM documents")
def csv_multiline(spark, folder):
    path = scratch(spark, "csv")
    df = table(spark, folder, "documents").select("doc_id", "text", "lang")
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return sources.read_csv(spark, path)


@query("tsv_round_trip", ORDER_TEXT)
def tsv_round_trip(spark, folder):
    path = scratch(spark, "tsv")
    order_text(spark, folder).write.csv(path, header=True, sep="\t")
    return tidy(sources.read_tsv(spark, path), 2)


@query(
    "csv_late_text_kept",
    "SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 AND o_orderpriority = '5-LOW' THEN 'n/a' ELSE o_custkey::VARCHAR END AS o_custkey FROM orders",
)
def csv_late_text(spark, folder):
    path = scratch(spark, "csv")
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey >= 1000 AND o_orderpriority = '5-LOW' THEN 'n/a' ELSE cast(o_custkey AS STRING) END AS o_custkey",
    )
    df.orderBy("o_orderkey").write.csv(path, header=True)
    return sources.read_csv(spark, path)


JSON_SQL = "SELECT c_custkey, c_name, {address}, {money} AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey"


def customer_json(spark, folder):
    nation = F.broadcast(table(spark, folder, "nation"))
    df = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    path = scratch(spark, "json")
    df.select(
        "c_custkey", "c_name", F.struct(F.col("n_name").alias("nation"), F.col("c_nationkey").alias("key")).alias("address"), "c_acctbal"
    ).write.json(path)
    return path


@query(
    "json_nested_as_text",
    JSON_SQL.format(address="""'{"key":' || c_nationkey || ',"nation":"' || n_name || '"}' AS address""", money=r("c_acctbal", 2)),
)
def json_text(spark, folder):
    return tidy(sources.read_json(spark, customer_json(spark, folder), lines=True), 2)


@query(
    "json_null_keys",
    """SELECT c_custkey, '{"balance":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE c_nationkey::VARCHAR END || ',"key":' || c_nationkey || '}' AS cell FROM customer""",
)
def json_null_keys(spark, folder):
    path = scratch(spark, "json")
    cell = "named_struct('balance', CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END, 'key', c_nationkey) AS cell"
    table(spark, folder, "customer").selectExpr("c_custkey", cell).write.option("ignoreNullFields", "false").json(path)
    return sources.read_json(spark, path, lines=True)


@query(
    "json_flattened",
    JSON_SQL.format(address="""c_nationkey::BIGINT AS "address.key", n_name AS "address.nation\"""", money=r("c_acctbal", 2)),
)
def json_flat(spark, folder):
    return tidy(sources.read_json(spark, customer_json(spark, folder), nested="flatten", lines=True), 2)


def _write_databases(path):
    def write(batches):
        import pandas as pd

        for number, batch in enumerate(batches):
            part = f"{int(batch['c_custkey'].iloc[0])}-{number}"
            connection = sqlite3.connect(os.path.join(path, f"{part}.db"))
            batch.to_sql('people "x"', connection, index=False, if_exists="append")
            connection.close()
            yield pd.DataFrame({"n": [len(batch)]})

    return write


CUSTOMER_SQL = f"SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, {r('c_acctbal', 2)} AS c_acctbal, c_mktsegment FROM customer"


@query("sqlite_round_trip", CUSTOMER_SQL)
def sqlite_round_trip(spark, folder):
    path = scratch(spark, "sqlite")
    os.makedirs(path)
    table(spark, folder, "customer").repartition(3).mapInPandas(_write_databases(path), "n long").agg(F.sum("n")).collect()
    return tidy(sources.read_sqlite(spark, path, rows_per_task=200), 2)


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def _sheet_row(values) -> str:
    cells = []
    for v in values:
        if isinstance(v, str):
            cells.append(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        else:
            cells.append(f"<c><v>{v}</v></c>")
    return f"<row>{''.join(cells)}</row>"


def _write_workbooks(path):
    def write(batches):
        import pandas as pd

        for number, batch in enumerate(batches):
            lines = [_sheet_row(batch.columns)] + [_sheet_row(v) for v in batch.itertuples(index=False)]
            name = f"{int(batch['c_custkey'].iloc[0])}-{number}.xlsx"
            with zipfile.ZipFile(os.path.join(path, name), "w") as book:
                book.writestr("xl/worksheets/sheet1.xml", SHEET.format("".join(lines)))
            yield pd.DataFrame({"n": [len(batch)]})

    return write


@query("xlsx_round_trip", CUSTOMER_SQL)
def xlsx_round_trip(spark, folder):
    path = scratch(spark, "xlsx")
    os.makedirs(path)
    table(spark, folder, "customer").repartition(3).mapInPandas(_write_workbooks(path), "n long").agg(F.sum("n")).collect()
    return tidy(sources.read_xlsx(spark, path), 2)


@query(
    "report_tables_orders",
    "SELECT * FROM (VALUES ('Data', (SELECT count(*) FROM orders)), ('Summary', 6), ('Correlations', 9), ('Outliers', 3), ('Quality', 5)) "
    "AS t(sheet, rows)",
)
def report_tables(spark, folder):
    df = table(spark, folder, "orders")
    report = compare.full_report(df, order_by=["o_orderkey"])
    written = sources.write_report_tables(df, report, scratch(spark, "report"), "json")
    out = None
    for path in written:
        one = spark.read.json(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(os.path.basename(path)).alias("sheet"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("write_json_without_nan", f"SELECT o_orderkey, {r('CASE WHEN o_orderstatus = $$F$$ THEN o_totalprice END', 2)} AS o_totalprice FROM orders")
def json_safe(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN double('NaN') ELSE double('-Infinity') END AS o_totalprice",
    )
    return tidy(sources.json_safe(df), 2)


@query(
    "html_tables_from_orders",
    """SELECT o_orderkey AS page_id, 0 AS table_no, 'Order ' || o_orderkey AS caption, 2 AS rows, 2 AS cols, row_no,
       CASE row_no WHEN 0 THEN 'Status|Priority & more' ELSE o_orderstatus || '|' || o_orderpriority END AS cells
       FROM orders, (VALUES (0), (1)) AS t(row_no)""",
)
def html_tables(spark, folder):
    page = (
        "concat('<html><body><p>x</p><table><caption> Order ', o_orderkey, '</caption><tr><th>Status</th><th>Priority &amp; more</th></tr>"
        "<tr><td>', o_orderstatus, '</td><td> <b>', o_orderpriority, '</b></td></tr></table><table><tr><td>one row</td></tr></table>')"
    )
    df = table(spark, folder, "orders").selectExpr("o_orderkey AS page_id", f"{page} AS html")
    return sources.extract_html_tables(df).withColumn("cells", F.concat_ws("|", "cells"))


@query("html_tables_in_pages", "SELECT 0::BIGINT AS tables FROM pages HAVING count(*) FILTER (WHERE html LIKE '%<table%') = 0")
def html_tables_pages(spark, folder):
    return sources.extract_html_tables(table(spark, folder, "pages")).agg(F.count_distinct("page_id", "table_no").alias("tables"))


@query(
    "data_links_in_pages",
    """WITH s AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site FROM pages)
       SELECT page_id, site || '/files/' || page_id || '.CSV?v=1' AS href, page_id || '.CSV' AS filename, 'Get table' AS text FROM s
       UNION ALL SELECT page_id, 'https://data.example.org/' || page_id || '/set.parquet', 'set.parquet', 'set.parquet' FROM s""",
)
def data_links(spark, folder):
    links = (
        "concat('<a class=x href=\"/files/', page_id, '.CSV?v=1\">Get <i>table</i></a>"
        "<A HREF=''https://data.example.org/', page_id, '/set.parquet''></A><a href=\"/files/', page_id, '.CSV?v=1\">again</a>"
        "<a href=\"page.html\">no</a>', html)"
    )
    df = table(spark, folder, "pages").selectExpr("page_id", "url", f"{links} AS html")
    return sources.extract_data_links(df)
