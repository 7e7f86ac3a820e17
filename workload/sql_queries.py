"""The SQL surface: guarded queries over a table called df, and row access."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import rows, sql
from workload.common import r, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return keep


def over(name: str, source: str, text: str, oracle: str | None = None, digits: int = 2) -> None:
    """Register a statement over df = ``source``; DuckDB runs it over the same table."""

    def run(spark, folder):
        return tidy(sql.sql_frame(table(spark, folder, source), text), digits)

    QUERIES[name] = run
    ORACLES[name] = (oracle or text).replace(" df", f" {source}")


over(
    "sql_filter_project", "customer",
    "SELECT c_custkey, c_name, c_acctbal * 2 AS doubled FROM df WHERE c_mktsegment ILIKE 'build%' AND c_acctbal > 0",
    f"SELECT c_custkey, c_name, {r('c_acctbal * 2', 2)} AS doubled FROM df WHERE c_mktsegment ILIKE 'build%' AND c_acctbal > 0",
)
over(
    "sql_self_join", "orders",
    "SELECT a.o_orderkey, b.o_orderkey AS other FROM df a JOIN df b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate "
    "AND a.o_orderkey < b.o_orderkey",
)
over(
    "sql_semi_join", "orders",
    "SELECT o_orderkey FROM df a WHERE EXISTS (SELECT 1 FROM df b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P' "
    "AND a.o_orderstatus = 'F')",
)
over(
    "sql_anti_join", "orders",
    "SELECT o_orderkey FROM df a WHERE NOT EXISTS (SELECT 1 FROM df b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')",
)
# The rows within a band are those up to its end less those under its start, so no pair is formed: both
# ends are placed among the prices of their brand by running counts. These run inside cells, which keeps
# a brand from filling a task; a cell starts with the count of the cells before it.
RANGE_COUNTS = """
    WITH prices AS (
      SELECT p_brand, p_retailprice AS price, count(*) AS n FROM df
      WHERE p_brand IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY p_brand, p_retailprice
    ), marks AS (
      SELECT p_brand, price, n, mark.at, mark.kind, CASE WHEN isnan(mark.at) THEN 9223372036854775807 ELSE floor(mark.at / 5) END AS cell
      FROM (SELECT p_brand, price, n, explode(array(named_struct('at', price - 5, 'kind', 'a start'),
        named_struct('at', price + 0, 'kind', 'b price'), named_struct('at', price + 5, 'kind', 'c end'))) AS mark FROM prices) x
    ), cells AS (
      SELECT p_brand, cell, sum(n) OVER (PARTITION BY p_brand ORDER BY cell ROWS UNBOUNDED PRECEDING) - n AS earlier
      FROM (SELECT p_brand, cell, sum(if(kind = 'b price', n, 0)) AS n FROM marks GROUP BY p_brand, cell) x
    ), placed AS (
      SELECT p_brand, price, kind, cell, sum(if(kind = 'b price', n, 0)) OVER (PARTITION BY p_brand, cell ORDER BY at, kind ROWS UNBOUNDED PRECEDING) AS inside
      FROM marks
    ), bands AS (
      SELECT p.p_brand, p.price, sum(if(p.kind = 'c end', 1, -1) * (c.earlier + p.inside)) AS near
      FROM placed p JOIN cells c ON p.p_brand = c.p_brand AND p.cell = c.cell WHERE p.kind <> 'b price' GROUP BY p.p_brand, p.price
    )
    SELECT a.p_partkey, sum(b.near) AS near FROM df a JOIN bands b ON a.p_brand = b.p_brand AND a.p_retailprice = b.price
    GROUP BY a.p_partkey"""
over(
    "sql_range_join", "part",
    RANGE_COUNTS,
    "SELECT a.p_partkey, count(*) AS near FROM df a JOIN df b ON a.p_brand = b.p_brand AND b.p_retailprice BETWEEN "
    "a.p_retailprice - 5 AND a.p_retailprice + 5 GROUP BY a.p_partkey",
)
over(
    "sql_as_of_join", "events",
    "WITH buys AS (SELECT user_id, event_id, ts FROM df WHERE event_type = 'purchase'), "
    "views AS (SELECT user_id, event_id AS view_id, ts AS seen FROM df WHERE event_type = 'view') "
    "SELECT b.event_id, max_by(v.view_id, v.seen) AS last_view FROM buys b JOIN views v ON v.user_id = b.user_id AND v.seen <= b.ts GROUP BY b.event_id",
)
over(
    "sql_aggregate", "orders",
    "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, "
    "count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, round(median(o_totalprice), 2) AS mid FROM df GROUP BY ALL",
)
over("sql_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM df")
over(
    "sql_rollup", "orders",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM df GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
over(
    "sql_cube", "orders",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM df GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
over(
    "sql_grouping_sets", "orders",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM df GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
over(
    "sql_window", "events",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, "
    "round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, "
    "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, "
    "ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter_ FROM df",
)
over(
    "sql_latest_per_user", "events",
    "SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM df) x WHERE k = 1",
)
over("sql_top_k", "orders", "SELECT o_orderkey, o_totalprice FROM df ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
over(
    "sql_set_operations", "orders",
    "SELECT o_custkey FROM df WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM df WHERE o_orderstatus = 'O' "
    "EXCEPT SELECT o_custkey FROM df WHERE o_orderstatus = 'P'",
)
over(
    "sql_union", "orders",
    "SELECT o_orderkey, 'done' AS kind FROM df WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'open' FROM df WHERE o_orderstatus = 'O'",
)
over(
    "sql_cte_subquery", "orders",
    "WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM df GROUP BY o_custkey) "
    "SELECT o_custkey, round(total, 2) AS total FROM totals WHERE total > (SELECT avg(total) * 1.5 FROM totals)",
)
over(
    "sql_strings", "customer",
    "SELECT c_custkey, upper(substring(c_mktsegment, 1, 3)) AS short, length(c_name) AS size, replace(c_name, 'Customer#', '') AS num, "
    "concat(c_mktsegment, '/', c_name) AS joined FROM df",
)
over(
    "sql_dates", "orders",
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, "
    "count(*) FILTER (WHERE dayofweek(o_orderdate) IN (1, 7)) AS weekend FROM df GROUP BY year(o_orderdate), month(o_orderdate)",
    "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n, "
    "count(*) FILTER (WHERE isodow(o_orderdate) IN (6, 7)) AS weekend FROM df GROUP BY ALL",
)
over(
    "sql_json", "events",
    "SELECT event_id, cast(get_json_object(props, '$.k') AS INT) AS k FROM df",
    "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM df",
)
over(
    "sql_arrays", "events",
    "SELECT user_id, array_join(array_sort(collect_set(event_type)), ',') AS kinds, size(collect_set(event_type)) AS n FROM df GROUP BY user_id",
    "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(DISTINCT event_type)::INT AS n FROM df GROUP BY user_id",
)
over(
    "sql_explode", "documents",
    "SELECT word, count(*) AS n FROM (SELECT explode(split(lower(source), '[^a-z]+')) AS word FROM df) x GROUP BY word",
    "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(source), '[^a-z]+')) AS word FROM df) x GROUP BY word",
)
over(
    "sql_pivot", "orders",
    "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM df) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM df GROUP BY 1",
)
over(
    "sql_quantiles", "orders",
    "SELECT o_orderpriority, round(percentile(o_totalprice, 0.9), 2) AS p90, round(stddev_samp(o_totalprice), 2) AS sd FROM df GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 2) AS p90, round(stddev_samp(o_totalprice), 2) AS sd FROM df GROUP BY o_orderpriority",
)
over(
    "sql_range_function", "orders",
    "SELECT r.id AS unit, count(o_orderkey) AS n FROM range(10) r LEFT JOIN df ON df.o_orderkey % 10 = r.id GROUP BY r.id",
    "SELECT r.id AS unit, count(o_orderkey) AS n FROM range(10) r(id) LEFT JOIN orders ON orders.o_orderkey % 10 = r.id GROUP BY r.id",
)


@query(
    "run_sql_page",
    "SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders ORDER BY orders.o_orderkey LIMIT 1000 OFFSET 500",
)
def run_sql_page(spark, folder):
    found = sql.run_sql(
        table(spark, folder, "orders"),
        "SELECT cast(o_orderkey AS STRING) AS o_orderkey, o_orderdate FROM df ORDER BY df.o_orderkey",
        limit=1000,
        offset=500,
        timeout_seconds=600,
    )
    return spark.createDataFrame([tuple(row) for row in found.rows], "o_orderkey string, o_orderdate string")


@query(
    "select_rows_orders",
    "SELECT *, (SELECT count(*) FROM orders) AS total_rows, (SELECT count(*) > 5000 FROM orders) AS truncated FROM "
    "(SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5000)",
)
def select_rows(spark, folder):
    page = rows.select_rows(table(spark, folder, "orders"), ["o_orderkey", "o_orderstatus"], order_by=["o_orderkey"])
    return page.rows.withColumns({"total_rows": F.lit(page.total_rows).cast("long"), "truncated": F.lit(page.truncated)})


@query(
    "preview_orders",
    "SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') AS o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 50",
)
def preview(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))
    return rows.preview(df, order_by=["o_orderkey"])


@query(
    "sort_rows_descending",
    "SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders) "
    "ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 100",
)
def sort_rows(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", "nullif(o_orderpriority, '5-LOW') AS o_orderpriority")
    return rows.sort_rows(df, "o_orderpriority", "desc", tie_break=["o_orderkey"])


@query(
    "sanitize_formulas_customer",
    """SELECT c_custkey, '''=' || c_name AS "'=name", CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal::DECIMAL(12,2)::VARCHAR
       ELSE c_acctbal::DECIMAL(12,2)::VARCHAR END AS balance FROM customer""",
)
def sanitize(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("="), "c_name").alias("=name"),
        F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("balance"),
    )
    return rows.sanitize_formulas(df)
