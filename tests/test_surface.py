"""SQL guard, sources, sinks and charts."""

import sqlite3
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import AnalysisError, sources
from tabulon.operators import charts, compare, rows, sql
from tabulon.operators.clean import Cleaner


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 1 AS dropped_calls, 2 AS inserted_by, 3 AS last_altered FROM df LIMIT 1",
        "SELECT 'Alter Ego' AS who FROM df LIMIT 1",
        "SELECT 'it\\'s; drop' AS who FROM df LIMIT 1",
        "WITH t AS (SELECT o_orderkey FROM df) SELECT count(*) AS n FROM t;",
        "SELECT /* drop */ 1 AS x -- delete\nFROM df LIMIT 1",
    ],
)
def test_harmless_sql(orders, text):
    assert sql.run_sql(orders, text).row_count == 1


def test_a_view_of_the_caller_survives(spark, orders):
    spark.range(3).createOrReplaceTempView("df")
    try:
        assert sql.run_sql(orders, "SELECT count(*) AS n FROM df").rows[0][0] == orders.count()
        assert sql.run_sql(orders, "WITH t AS (SELECT 1 AS a) SELECT a, count(*) AS n FROM t, df GROUP BY a").rows[0][1] == orders.count()
        assert spark.table("df").count() == 3
    finally:
        spark.catalog.dropTempView("df")


@pytest.mark.parametrize(
    "text",
    [
        "",
        "DROP TABLE df",
        "UPDATE df SET a = 1",
        "SELECT 1; DELETE FROM df",
        "SELECT 1; SELECT 2",
        "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
        "SELECT * FROM `/root/testdata/sf0.001/orders.parquet`",
        "SELECT java_method('java.lang.System', 'exit') FROM df",
        "SELECT '\\'', reflect('java.lang.System', 'x'), '' FROM df",
        "SELECT * FROM hidden_view",
        "SELECT * FROM df a, hidden_view b",
        "WITH hidden_view AS (SELECT * FROM hidden_view) SELECT * FROM hidden_view",
    ],
)
def test_refused_sql(spark, orders, text):
    orders.createOrReplaceTempView("hidden_view")
    try:
        with pytest.raises(Exception) as caught:
            sql.run_sql(orders, text)
        assert isinstance(caught.value, AnalysisError) or "NOT_FOUND" in str(caught.value)
    finally:
        spark.catalog.dropTempView("hidden_view")


def test_view_is_gone_and_pages(spark, orders):
    page = sql.run_sql(orders, "SELECT o_orderkey, o_orderdate FROM df ORDER BY 1", limit=10, offset=5)
    assert page.truncated and page.has_more and page.row_count == 10 and page.rows[0][0] == 5
    assert isinstance(page.rows[0][1], str)
    assert "df" not in [t.name for t in spark.catalog.listTables()]
    for bad in ({"limit": 0}, {"limit": 10_001}, {"offset": -1}):
        with pytest.raises(AnalysisError):
            sql.run_sql(orders, "SELECT 1 FROM df", **bad)


def test_time_limit(orders):
    start = time.time()
    with pytest.raises(AnalysisError, match="execution limit"):
        sql.run_sql(
            orders, "SELECT count(*) FROM df a, df b, df c WHERE a.o_totalprice + b.o_totalprice < c.o_totalprice",
            timeout_seconds=1,
        )
    assert time.time() - start < 30


ROWS = [("North", 10), ("South", 20)]


def _workbook(path, table):
    def cell(v):
        return f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"

    body = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in table)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")


@pytest.mark.parametrize("kind", ["csv", "tsv", "xlsx", "json", "parquet", "sqlite", "noextension"])
def test_formats(spark, tmp_path, kind):
    path = str(tmp_path / ("table" if kind == "noextension" else f"table.{kind}"))
    if kind in ("csv", "noextension"):
        open(path, "w").write("region,sales\nNorth,10\nSouth,20\n")
    elif kind == "tsv":
        open(path, "w").write("region\tsales\nNorth\t10\nSouth\t20\n")
    elif kind == "json":
        open(path, "w").write('[{"region": "North", "sales": 10}, {"region": "South", "sales": 20}]')
    elif kind == "xlsx":
        _workbook(path, [("region", "sales"), *ROWS])
    elif kind == "sqlite":
        connection = sqlite3.connect(path)
        connection.execute("CREATE TABLE t (region TEXT, sales INTEGER)")
        connection.executemany("INSERT INTO t VALUES (?, ?)", ROWS)
        connection.commit()
        connection.close()
    else:
        spark.createDataFrame(ROWS, "region string, sales long").write.parquet(path)
    df = sources.read_any(spark, path)
    assert dict(df.dtypes) == {"region": "string", "sales": "bigint"}
    assert sorted(tuple(r) for r in df.select("region", "sales").collect()) == ROWS


def test_unknown_format(spark):
    with pytest.raises(AnalysisError, match="Unsupported"):
        sources.read_any(spark, "/tmp/x.docx")


def test_csv_inference(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e\n1,x,true,2024-01-01,\n,"two\nlines",false,2024-01-02,\n3,"q""q",,x,\n')
    df = sources.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean", "string", "string"]
    assert [tuple(r) for r in df.collect()][1] == (None, "two\nlines", False, "2024-01-02", None)
    late = tmp_path / "late.csv"
    late.write_text("a\n" + "1\n" * 50 + "oops\n")
    kept = sources.read_csv(spark, str(late))
    assert dict(kept.dtypes) == {"a": "string"} and kept.filter("a = 'oops'").count() == 1


def test_nested_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"id": 1, "address": {"zip": "1", "geo": {"x": 2}}, "tags": ["a"]}')
    text = sources.read_json(spark, str(path)).first().asDict()
    assert text == {"address": '{"geo":{"x":2},"zip":"1"}', "id": 1, "tags": '["a"]'}
    assert set(sources.read_json(spark, str(path), nested="flatten").columns) == {"address.zip", "address.geo.x", "id", "tags"}


def test_sqlite_types_hold_all_cells(spark, tmp_path):
    for file, extra in (("a", ""), ("b", ", late INTEGER")):
        connection = sqlite3.connect(str(tmp_path / f"{file}.db"))
        connection.execute(f"CREATE TABLE t (n, frac, big{extra})")
        rows = [(i, i, 2**60 + 1) for i in range(10_050)] if file == "a" else [(7, 2.5, 0.5, 9), ("text", 3, 1, None)]
        connection.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(rows[0]))})", rows)
        if file == "a":
            connection.execute("INSERT INTO t VALUES (0.5, 0.25, 3)")
        connection.commit()
        connection.close()
    df = sources.read_sqlite(spark, str(tmp_path), rows_per_task=3000)
    assert df.dtypes == [("n", "string"), ("frac", "double"), ("big", "string"), ("late", "bigint")]
    assert df.count() == 10_053 and df.where("n IS NULL OR frac IS NULL OR big IS NULL").count() == 0
    assert df.where(f"big = '{2**60 + 1}'").count() == 10_050 and df.where("n IN ('0.5', 'text')").count() == 2
    assert [r.late for r in df.where("late IS NOT NULL").collect()] == [9]


def test_sqlite_names_are_quoted(spark, tmp_path):
    path = str(tmp_path / "evil.db")
    connection = sqlite3.connect(path)
    connection.execute('CREATE TABLE "x UNION SELECT name, sql FROM sqlite_master--" (col1 TEXT, col2 TEXT)')
    connection.execute("CREATE TABLE secret (a TEXT)")
    connection.commit()
    connection.close()
    assert sources.read_sqlite(spark, path).count() == 0
    empty = str(tmp_path / "empty.db")
    sqlite3.connect(empty).close()
    open(empty, "wb").close()
    with pytest.raises(AnalysisError, match="No tables"):
        sources.read_sqlite(spark, empty)


def test_formulas_are_quoted(spark, tmp_path):
    df = spark.createDataFrame([("a", "=B7*2"), ("b", "+49 30 1234"), ("c", "@handle"), ("d", "plain")], ["name", "=formula"])
    safe = rows.sanitize_formulas(df)
    assert safe.columns == ["name", "'=formula"]
    assert [r[1] for r in safe.collect()] == ["'=B7*2", "'+49 30 1234", "'@handle", "plain"]
    sources.write_csv(df, str(tmp_path / "out"))
    assert "'=formula" in sources.read_csv(spark, str(tmp_path / "out")).columns


def test_report_tables(spark, tmp_path, orders):
    written = sources.write_report_tables(orders, compare.full_report(orders), str(tmp_path / "r"), "csv")
    assert [p.rsplit("/", 1)[1] for p in written] == ["Data", "Summary", "Correlations", "Outliers", "Quality"]


def test_html(spark):
    page = (
        "<table><caption> Cap </caption><tr><th>A</th><th>B</th></tr><tr><td>1 &amp; 2</td><td><b>x</b> y</td></tr><tr></tr></table>"
        "<table><tr><td>only</td></tr></table><a href='data.csv?x=1'>Get <b>it</b></a><a href=\"/f/T.XLSX\"></a>"
        "<a href=//z.org/p.json#a>far</a><a href='data.csv?x=1'>again</a><a href='q.html'>no</a>"
    )
    df = spark.createDataFrame([(1, "http://ex.com/a/b.html?y=/c/d", page)], "page_id long, url string, html string")
    found = sources.extract_html_tables(df).collect()
    assert [(r["rows"], r["cols"], r["caption"], r["cells"]) for r in found] == [
        (3, 2, "Cap", ["A", "B"]), (3, 2, "Cap", ["1 & 2", "x y"]),
    ]
    links = {r["href"]: (r["filename"], r["text"]) for r in sources.extract_data_links(df).collect()}
    assert links == {
        "http://ex.com/a/data.csv?x=1": ("data.csv", "Get it"),
        "http://ex.com/f/T.XLSX": ("T.XLSX", "T.XLSX"),
        "http://z.org/p.json#a": ("p.json", "far"),
    }


def test_row_access(orders):
    page = rows.select_rows(orders, ["o_orderkey"], limit=10)
    assert page.rows.count() == 10 and page.truncated and page.total_rows == orders.count()
    with pytest.raises(AnalysisError):
        rows.select_rows(orders, ["nope"])
    with pytest.raises(AnalysisError):
        rows.select_rows(orders, limit=20_001)


def test_pareto_ends_at_hundred(orders):
    found = charts.pareto(orders, "o_custkey", "o_totalprice", top_n=5).collect()
    assert found[-1]["category"] == "Other" and abs(found[-1]["cumulative_percent"] - 100) < 1e-9
    with pytest.raises(AnalysisError):
        charts.pareto(orders.withColumn("z", F.lit(0)), "o_custkey", "z")


def test_charts_check_their_input(orders, spark):
    with pytest.raises(AnalysisError, match="numeric"):
        charts.trend(orders, "o_custkey")
    with pytest.raises(AnalysisError):
        charts.top_n(orders, "o_orderstatus", "o_totalprice", "mode")
    with pytest.raises(AnalysisError):
        charts.missing_matrix(orders, ["o_orderkey"])
    constant = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert charts.kde(constant, "v").count() == 0
    assert charts.histogram(constant, "v").agg(F.sum("count")).first()[0] == 2
    assert charts.waterfall(orders, "o_orderstatus", "o_totalprice").orderBy("rank").collect()[-1]["category"] == "Total"


def test_duplicates_of_a_subset(spark):
    rows = [(k % 3, None if k % 5 == 0 else k % 4, str(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    found = [
        {tuple(r) for r in Cleaner(df.repartition(n, F.rand(n)), ["at"]).remove_duplicates(["k"], keep=keep).df.collect()}
        for keep in ("first", "last")
        for n in (1, 3, 7)
    ]
    assert found[0] == found[1] == found[2] and found[3] == found[4] == found[5]  # ties too, however the rows lie
    assert all(r[1] is None for r in found[0]) and {r[1] for r in found[3]} == {3} and len(found[0]) == 3
    once = df.unionByName(spark.createDataFrame([(9, 1, "x")], df.schema))
    cleaner = Cleaner(once, ["at"])
    assert [tuple(r) for r in cleaner.remove_duplicates(["k"], keep=False).df.collect()] == [(9, 1, "x")]
    plan = cleaner.remove_duplicates(["k"]).df._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") >= 2  # a task hands on one row a key
    maps = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 1}), (2, {"b": 1})], "i int, m map<string,int>")
    assert Cleaner(maps).remove_duplicates().df.count() == 2 and Cleaner(maps).remove_duplicates(keep=False).df.first()["i"] == 2


@pytest.mark.parametrize("spread", ["plain", "outlier", "two values"])
def test_kde_equals_the_sum_of_kernels(spark, spread):
    draw = np.random.default_rng(3)
    v = {
        "plain": draw.normal(50, 7, 3000),
        "outlier": np.append(draw.normal(0, 1, 2000), [400.0, -900.0]),
        "two values": np.repeat([1.0, 2.0], [5, 1]),
    }[spread]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(5)
    got = charts.kde(df, "v", points=60).orderBy("point").toPandas()
    width = len(v) ** (-1 / 5) * v.std(ddof=1)
    grid = np.linspace(v.min(), v.max(), 60)
    z = (grid[:, None] - v[None, :]) / width
    want = np.exp(-0.5 * z * z).sum(axis=1) / (len(v) * width * np.sqrt(2 * np.pi))
    assert got["x"].tolist() == grid.tolist()
    assert np.abs(got["density"] - want).max() <= 1e-11 / width
    assert np.allclose(got["scaled"], want * len(v) * (v.max() - v.min()) / 30, atol=1e-9 * len(v))
