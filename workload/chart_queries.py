"""Chart data."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulon.operators import chart_builder as builder, charts
from workload.common import GAPPY_SQL, LINEITEM_NUMBERS, gappy, linear, r, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


LIMITS = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 30 AS w, avg(o_totalprice) AS mean, median(o_totalprice) AS med FROM orders)"


@query(
    "histogram_order_price",
    f"""SELECT b.i::INT AS bin, {r('any_value(lo + b.i * w)', 2)} AS lower, {r('any_value(lo + (b.i + 1) * w)', 2)} AS upper,
        count(o_totalprice) AS count, {r('any_value(mean)', 2)} AS mean, {r('any_value(med)', 2)} AS median, 0::BIGINT AS infinite
        FROM range(30) AS b(i), {LIMITS} AS l LEFT JOIN orders ON least(floor((o_totalprice - lo) / w), 29) = b.i GROUP BY b.i""",
)
def histogram(spark, folder):
    return tidy(charts.histogram(table(spark, folder, "orders"), "o_totalprice"), 2)


FINITE = "(SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS w, (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) AS lost FROM (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 97 <> 0))"


@query(
    "histogram_infinite",
    f"""SELECT b.i::INT AS bin, {r('any_value(lo + b.i * w)', 2)} AS lower, count(o_totalprice) AS count, any_value(lost) AS infinite
        FROM range(30) AS b(i), {FINITE} AS l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 97 <> 0) ON least(floor((o_totalprice - lo) / w), 29) = b.i
        GROUP BY b.i""",
)
def histogram_infinite(spark, folder):
    df = table(spark, folder, "orders").selectExpr("CASE WHEN o_orderkey % 97 = 0 THEN double('Infinity') ELSE o_totalprice END AS v")
    return tidy(charts.histogram(df, "v").select("bin", "lower", "count", "infinite"), 2)


KDE_SQL = """WITH m AS (SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * power(count(*), -0.2) AS h
    FROM customer), g AS (SELECT i::INT AS point, lo + i * (hi - lo) / 199.0 AS x, n, lo, hi, h FROM range(200) AS t(i), m)"""


@query(
    "kde_account_balance",
    KDE_SQL
    + f""" SELECT point, {r('any_value(x)', 3)} AS x, {r(f'sum(exp(-0.5 * power((x - c_acctbal) / h, 2))) / any_value(n * h) / sqrt(2 * {math.pi})', 9)}
        AS density, {r(f'sum(exp(-0.5 * power((x - c_acctbal) / h, 2))) / any_value(h) / sqrt(2 * {math.pi}) * any_value(hi - lo) / 30', 6)} AS scaled
        FROM g, customer GROUP BY point""",
)
def kde(spark, folder):
    found = charts.kde(table(spark, folder, "customer"), "c_acctbal")
    return found.select(
        "point",
        (F.round("x", 3) + F.lit(0.0)).alias("x"),
        (F.round("density", 9) + F.lit(0.0)).alias("density"),
        (F.round("scaled", 6) + F.lit(0.0)).alias("scaled"),
    )


Q1, Q3 = linear("v", 0.25), linear("v", 0.75)
PRICE_CUBES = "(SELECT power(o_totalprice / 1000, 3) AS v FROM orders)"


@query(
    "box_stats_price_cubes",
    f"""SELECT 'v' AS "column", {r('q1', 2)} AS q1, {r('med', 2)} AS median, {r('q3', 2)} AS q3, {r('mean', 2)} AS mean,
        {r('q1 - 1.5 * (q3 - q1)', 2)} AS lower_fence, {r('q3 + 1.5 * (q3 - q1)', 2)} AS upper_fence,
        {r('(SELECT min(v) FROM ' + PRICE_CUBES + ' WHERE v >= q1 - 1.5 * (q3 - q1))', 2)} AS whisker_low,
        {r('(SELECT max(v) FROM ' + PRICE_CUBES + ' WHERE v <= q3 + 1.5 * (q3 - q1))', 2)} AS whisker_high,
        (SELECT count(*) FROM {PRICE_CUBES} WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count
        FROM (SELECT {Q1} AS q1, median(v) AS med, {Q3} AS q3, avg(v) AS mean FROM {PRICE_CUBES})""",
)
def box_stats(spark, folder):
    df = table(spark, folder, "orders").selectExpr("power(o_totalprice / 1000, 3) AS v")
    return tidy(charts.box_stats(df, "v"), 2)


@query(
    "box_outliers_price_cubes",
    f"SELECT {r('v', 2)} AS v FROM {PRICE_CUBES}, (SELECT {Q1} AS q1, {Q3} AS q3 FROM {PRICE_CUBES}) "
    "WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)",
)
def box_outliers(spark, folder):
    return tidy(charts.box_outliers(table(spark, folder, "orders").selectExpr("power(o_totalprice / 1000, 3) AS v"), "v"), 2)


@query(
    "category_counts_brand",
    f"""SELECT p_brand AS value, count(*) AS count, {r('count(*) / (SELECT count(*) FROM part)::DOUBLE * 100', 1)} AS percent
        FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def category_counts(spark, folder):
    return tidy(charts.category_counts(table(spark, folder, "part"), "p_brand"), 1)


@query(
    "missing_matrix_gaps",
    f"""SELECT i AS row_index, (l_quantity IS NULL)::INT AS l_quantity, (l_discount IS NULL)::INT AS l_discount,
        (l_returnflag IS NULL)::INT AS l_returnflag FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber,
        l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER () // 200 AS step FROM {GAPPY_SQL}) WHERE i % step = 0""",
)
def missing_matrix(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return charts.missing_matrix(gappy(spark, folder), order, rows_per_task=20_000)


def _folded(n: int, order: str, value: str) -> str:
    return f"""WITH g AS (SELECT o_custkey AS c, {value} AS v FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER
        (ORDER BY {order} DESC, c) AS i FROM g), f AS (SELECT i, c::VARCHAR AS category, v FROM k WHERE i <= {n}
        UNION ALL SELECT {n + 1}, 'Other', sum(v) FROM k WHERE i > {n})"""


@query(
    "pareto_customer_revenue",
    _folded(15, "v", "sum(o_totalprice)")
    + f""" SELECT i::INT AS rank, category, {r('v', 2)} AS value, {r('sum(v) OVER (ORDER BY i) / (SELECT sum(v) FROM g) * 100')}
        AS cumulative_percent FROM f""",
)
def pareto(spark, folder):
    found = tidy(charts.pareto(table(spark, folder, "orders"), "o_custkey", "o_totalprice"))
    return found.withColumn("value", F.round("value", 2) + F.lit(0.0))


@query(
    "pareto_order_counts",
    f"""SELECT (row_number() OVER (ORDER BY n DESC, p))::INT AS rank, p AS category, n::DOUBLE AS value,
        {r('sum(n) OVER (ORDER BY n DESC, p) / sum(n) OVER () * 100')} AS cumulative_percent
        FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)""",
)
def pareto_counts(spark, folder):
    return tidy(charts.pareto(table(spark, folder, "orders"), "o_orderpriority"))


NATIONS = "(SELECT n_name, c_acctbal - 5000 AS gap FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def nation_gaps(spark, folder):
    nation = F.broadcast(table(spark, folder, "nation"))
    joined = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("n_name", (F.col("c_acctbal") - 5000).alias("gap"))


@query(
    "waterfall_nation_balance",
    f"""WITH g AS (SELECT n_name AS c, sum(gap) AS v FROM {NATIONS} GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY abs(v) DESC, c) AS i
        FROM g) SELECT i::INT AS rank, c AS category, {r('v', 2)} AS value, 'relative' AS measure FROM k WHERE i <= 12
        UNION ALL SELECT 13, 'Other', {r('sum(v)', 2)}, 'relative' FROM k WHERE i > 12
        UNION ALL SELECT 14, 'Total', {r('sum(v)', 2)}, 'total' FROM k""",
)
def waterfall(spark, folder):
    return tidy(charts.waterfall(nation_gaps(spark, folder), "n_name", "gap"), 2)


AGGS = {"sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "count": "count(o_totalprice)", "max": "max(o_totalprice)",
        "min": "min(o_totalprice)", "median": "median(o_totalprice)"}


@query(
    "top_n_customers_by_every_measure",
    " UNION ALL ".join(
        f"SELECT '{k}' AS measure, category, value FROM (SELECT o_custkey::VARCHAR AS category, {r(v, 2)} AS value, {v} AS s, o_custkey FROM orders GROUP BY o_custkey "
        f"ORDER BY s DESC, o_custkey LIMIT 5)"
        for k, v in AGGS.items()
    ),
)
def top_n(spark, folder):
    df = table(spark, folder, "orders")
    out = None
    for k in AGGS:
        found = charts.top_n(df, "o_custkey", "o_totalprice", k, 5).select(F.lit(k).alias("measure"), "category", "value")
        out = found if out is None else out.unionByName(found)
    return tidy(out, 2)


@query(
    "bottom_n_customers_by_orders",
    "SELECT o_custkey::VARCHAR AS category, count(*)::DOUBLE AS value FROM orders GROUP BY o_custkey ORDER BY 2, o_custkey LIMIT 10",
)
def bottom_n(spark, folder):
    return tidy(charts.top_n(table(spark, folder, "orders"), "o_custkey", ascending=True))


def _trend(day: str, unit: str, step: str, value: str, t: str, label: str, width: str) -> str:
    return f"""WITH b AS (SELECT date_trunc('{unit}', {day})::DATE AS d, {value} AS v FROM {t} GROUP BY 1),
        e AS (SELECT unnest(generate_series((SELECT min(d) FROM b)::TIMESTAMP, (SELECT max(d) FROM b)::TIMESTAMP, INTERVAL 1 {step}))::DATE AS d),
        f AS (SELECT e.d, coalesce(v, 0)::DOUBLE AS v FROM e LEFT JOIN b USING (d))
        SELECT {label} AS bucket, {r('v', 2)} AS value, {r(f'avg(v) OVER (ORDER BY d ROWS {width} PRECEDING)', 2)} AS rolling_mean,
        '{unit}' AS unit FROM f"""


@query("trend_monthly_revenue", _trend("o_orderdate", "month", "MONTH", "sum(o_totalprice)", "orders", "d", "6"))
def trend_month(spark, folder):
    return tidy(charts.trend(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"), 2)


@query("trend_daily_events", _trend("ts", "day", "DAY", "count(*)", "events", "d", "6"))
def trend_day(spark, folder):
    return tidy(charts.trend(table(spark, folder, "events"), "ts"), 2)


SHIPPED = "(SELECT make_date(2000, month(l_shipdate), day(l_shipdate)) AS day_of_year, l_quantity FROM lineitem)"


@query("trend_weekly_quantity", _trend("day_of_year", "week", "WEEK", "sum(l_quantity)", SHIPPED, "(d + 6)::DATE", "6"))
def trend_week(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "make_date(2000, month(l_shipdate), day(l_shipdate)) AS day_of_year", "l_quantity"
    )
    return tidy(charts.trend(df, "day_of_year", "l_quantity"), 2)


@query(
    "trend_monthly_median",
    f"""WITH b AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, median(o_totalprice) AS v FROM orders GROUP BY 1)
        SELECT d AS bucket, {r('v')} AS value, {r('avg(v) OVER (ORDER BY d ROWS 6 PRECEDING)')} AS rolling_mean, 'month' AS unit FROM b""",
)
def trend_median(spark, folder):
    return tidy(charts.trend(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "median"))


@query(
    "scatter_matrix_lineitem",
    """SELECT l_extendedprice, l_quantity, l_partkey FROM lineitem
       ORDER BY md5(concat_ws(':', l_orderkey, l_linenumber, 42)), l_extendedprice, l_quantity, l_partkey LIMIT 2000""",
)
def scatter(spark, folder):
    columns = ["l_extendedprice", "l_quantity", "l_partkey"]
    return charts.scatter_matrix(table(spark, folder, "lineitem"), columns, key=["l_orderkey", "l_linenumber"])


@query(
    "scatter_columns_lineitem",
    """SELECT "column" FROM (VALUES """
    + ", ".join(f"('{c}', (SELECT var_samp({c}::DOUBLE) FROM lineitem))" for c in LINEITEM_NUMBERS)
    + """) AS t("column", v) ORDER BY v DESC LIMIT 4""",
)
def scatter_columns(spark, folder):
    found = charts.scatter_matrix(table(spark, folder, "lineitem"), key=["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(c,) for c in found.columns], "column string")


HEAT = "(SELECT l_quantity, l_quantity * l_extendedprice AS revenue, l_extendedprice, 1 AS fixed FROM lineitem)"
HEAT_NAMES = ["l_quantity", "revenue", "l_extendedprice", "fixed"]


@query(
    "correlation_heatmap_derived",
    "WITH p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, "
        + ("NULL::DOUBLE" if b == "fixed" else r(f"(SELECT corr({a}, {b}) FROM {HEAT})"))
        + " AS correlation"
        for i, a in enumerate(HEAT_NAMES)
        for b in HEAT_NAMES[i + 1 :]
    )
    + ") SELECT *, coalesce(abs(correlation) > 0.7, false) AS annotated FROM p",
)
def heatmap(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_quantity * l_extendedprice AS revenue", "l_extendedprice", "1 AS fixed"
    )
    return tidy(charts.correlation_heatmap(df))


@query(
    "auto_pick_part",
    """SELECT (SELECT c FROM (SELECT 'p_name' AS c, count(DISTINCT p_name) AS k FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand)
       FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) WHERE k BETWEEN 2 AND 50 ORDER BY k DESC, c DESC LIMIT 1) AS category,
       (SELECT c FROM (SELECT 'p_partkey' AS c, var_samp(p_partkey) AS v FROM part UNION ALL SELECT 'p_size', var_samp(p_size) FROM part
       UNION ALL SELECT 'p_retailprice', var_samp(p_retailprice) FROM part) ORDER BY v DESC LIMIT 1) AS value""",
)
def auto_pick(spark, folder):
    return charts.auto_pick(table(spark, folder, "part"))


@query("detect_date_column_orders", "SELECT 'day_text' AS date_column FROM orders HAVING count(*) > 0")
def date_column(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderpriority", "date_format(o_orderdate, 'dd.MM.yyyy') AS day_text", "o_orderstatus"
    )
    return spark.createDataFrame([(charts.detect_date_column(df),)], "date_column string")


NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(
    "all_charts_customer",
    """SELECT chart, points::BIGINT AS points FROM (VALUES ('correlation_heatmap', 3), ('quality_radar', 6),
       ('scatter_matrix', (SELECT least(2000, count(*)) FROM customer)),
       ('pareto', (SELECT count(DISTINCT c_mktsegment) FROM customer)), ('top_n', (SELECT count(DISTINCT c_mktsegment) FROM customer)),
       ('waterfall', (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer)), ('categorical_bar:c_name', 10),
       ('categorical_bar:c_mktsegment', (SELECT count(DISTINCT c_mktsegment) FROM customer)), """
    + ", ".join(f"('distribution:{c}', 30), ('box_plot:{c}', 1), ('violin:{c}', 200)" for c in NUMBERS)
    + ") AS t(chart, points)",
)
def all_charts(spark, folder):
    return charts.chart_catalog(table(spark, folder, "customer"), ["c_custkey"])


STATUS = "coalesce(nullif(o_orderstatus, 'P'), 'null')"


def statuses(spark, folder):
    return table(spark, folder, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))


@query(
    "aggregate_single_label",
    f"SELECT {STATUS} AS label, {r('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1",
)
def agg_single(spark, folder):
    return tidy(builder.agg_single(statuses(spark, folder), "o_orderstatus", "o_totalprice"), 2)


@query("aggregate_text_as_zero", f"SELECT {STATUS} AS label, {r('sum(CASE WHEN o_custkey > 500 THEN o_custkey ELSE 0 END)', 2)} AS value FROM orders GROUP BY 1")
def agg_text(spark, folder):
    df = statuses(spark, folder).withColumn("mixed", F.expr("CASE WHEN o_custkey > 500 THEN cast(o_custkey AS STRING) ELSE 'n/a' END"))
    return tidy(builder.agg_single(df, "o_orderstatus", "mixed"), 2)


@query(
    "aggregate_label_pairs",
    f"SELECT {STATUS} AS first, o_orderpriority AS second, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2",
)
def agg_pairs(spark, folder):
    return tidy(builder.agg_pairs(statuses(spark, folder), "o_orderstatus", "o_orderpriority"), 2)


@query(
    "hierarchy_status_priority",
    f"""SELECT {STATUS} AS label, '' AS parent, {r('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1
        UNION ALL SELECT o_orderpriority, {STATUS}, {r('sum(o_totalprice)', 2)} FROM orders GROUP BY 1, 2""",
)
def hierarchy(spark, folder):
    return tidy(builder.hierarchy(statuses(spark, folder), "o_orderstatus", "o_orderpriority", "o_totalprice"), 2)


NODES = """WITH e AS (SELECT l_returnflag AS a, l_linestatus AS b, sum(l_quantity) AS v, count(*) AS c FROM lineitem GROUP BY 1, 2),
    n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS node FROM (SELECT a AS label FROM e UNION SELECT b FROM e))"""


@query(
    "flow_edges_flag_status",
    NODES
    + f""" SELECT s.node AS source, t.node AS target, a AS source_label, b AS target_label, {r('v', 2)} AS value
        FROM e JOIN n s ON s.label = a JOIN n t ON t.label = b""",
)
def flow_edges(spark, folder):
    return tidy(builder.flow_edges(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 2)


@query(
    "network_nodes_flag_status",
    NODES + f" SELECT node, label, {r('cos(2 * pi() * node / (SELECT count(*) FROM n))')} AS x, {r('sin(2 * pi() * node / (SELECT count(*) FROM n))')} AS y FROM n",
)
def network_nodes(spark, folder):
    return tidy(builder.network_nodes(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus"))


@query(
    "network_edges_user_type",
    """WITH e AS (SELECT user_id::VARCHAR AS a, event_type AS b, count(*) AS c FROM events GROUP BY 1, 2),
       n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS node FROM (SELECT a AS label FROM e UNION SELECT b FROM e))
       SELECT s.node AS source, t.node AS target, a AS source_label, b AS target_label, c::DOUBLE AS value
       FROM e JOIN n s ON s.label = a JOIN n t ON t.label = b""",
)
def network_edges(spark, folder):
    return tidy(builder.network_edges(table(spark, folder, "events"), "user_id", "event_type"), 2)


@query(
    "geo_values_nation",
    f"SELECT upper(lang) AS location, {r('n_chars', 2)} AS z, 'USA-states' AS location_mode FROM documents",
)
def geo_states(spark, folder):
    df = table(spark, folder, "documents").select(F.upper("lang").alias("code"), "n_chars")
    return tidy(builder.geo_values(df, "code", "n_chars"), 2)


@query(
    "geo_values_country_names",
    f"SELECT n_name AS location, {r('c_acctbal', 2)} AS z, 'country names' AS location_mode FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def geo_countries(spark, folder):
    nation = F.broadcast(table(spark, folder, "nation"))
    df = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return tidy(builder.geo_values(df, "n_name", "c_acctbal"), 2)


GROUPED = f"""SELECT o_orderpriority AS label, count(*) AS count, {r(linear('o_totalprice', 0.25), 2)} AS q1,
    {r('median(o_totalprice)', 2)} AS median, {r(linear('o_totalprice', 0.75), 2)} AS q3, {r('avg(o_totalprice)', 2)} AS mean,
    {r('min(o_totalprice)', 2)} AS min, {r('max(o_totalprice)', 2)} AS max FROM orders GROUP BY 1"""


@query("grouped_box_priority", GROUPED)
def grouped_box(spark, folder):
    return tidy(builder.grouped_box(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice"), 2)


@query(
    "grouped_histogram_priority",
    f"""SELECT o_orderpriority AS label, least(floor((o_totalprice - lo) / w), 29)::INT AS bin, count(*) AS count
        FROM orders, {LIMITS} AS l GROUP BY 1, 2""",
)
def grouped_histogram(spark, folder):
    return builder.grouped_histogram(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
