"""Cleaning steps on lineitem with derived gaps, orders, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators.clean import Cleaner
from workload.common import GAPPY_SQL, gappy, linear, r, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ID_LIST = IDS.split(", ")


@query(
    "drop_missing_rows",
    f"SELECT {IDS}, {r('l_quantity')} AS l_quantity, {r('l_discount')} AS l_discount, l_returnflag FROM {GAPPY_SQL} "
    "WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL",
)
def drop_missing_rows(spark, folder):
    done = Cleaner(gappy(spark, folder)).drop_missing_rows().df
    return tidy(done.select(*ID_LIST, "l_quantity", "l_discount", "l_returnflag"))


@query(
    "drop_missing_rows_share",
    f"SELECT {IDS}, l_returnflag FROM {GAPPY_SQL} WHERE (l_quantity IS NOT NULL)::INT + (l_discount IS NOT NULL)::INT "
    "+ (l_returnflag IS NOT NULL)::INT + 6 >= 8",
)
def drop_missing_rows_share(spark, folder):
    return Cleaner(gappy(spark, folder)).drop_missing_rows(0.1).df.select(*ID_LIST, "l_returnflag")


SPARSE = ["o_orderkey", "nullif(o_orderstatus, 'F') AS o_orderstatus",
          "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END AS o_orderpriority"]


@query("drop_missing_columns", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders")
def drop_missing_columns(spark, folder):
    return Cleaner(table(spark, folder, "orders").selectExpr(*SPARSE)).drop_missing_columns(0.5).df


@query(
    "impute_mean",
    f"SELECT {IDS}, {r(f'coalesce(l_quantity, (SELECT avg(l_quantity) FROM {GAPPY_SQL}))')} AS l_quantity, "
    f"{r(f'coalesce(l_discount, (SELECT avg(l_discount) FROM {GAPPY_SQL}))')} AS l_discount FROM {GAPPY_SQL}",
)
def impute_mean(spark, folder):
    return tidy(Cleaner(gappy(spark, folder)).impute_mean().df.select(*ID_LIST, "l_quantity", "l_discount"))


@query(
    "impute_median",
    f"SELECT {IDS}, {r(f'coalesce(l_quantity, (SELECT median(l_quantity) FROM {GAPPY_SQL}))')} AS l_quantity, "
    f"{r(f'coalesce(l_discount, (SELECT median(l_discount) FROM {GAPPY_SQL}))')} AS l_discount FROM {GAPPY_SQL}",
)
def impute_median(spark, folder):
    return tidy(Cleaner(gappy(spark, folder)).impute_median().df.select(*ID_LIST, "l_quantity", "l_discount"))


@query(
    "impute_mode",
    f"SELECT {IDS}, coalesce(l_returnflag, (SELECT l_returnflag FROM {GAPPY_SQL} WHERE l_returnflag IS NOT NULL "
    f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM {GAPPY_SQL}",
)
def impute_mode(spark, folder):
    return Cleaner(gappy(spark, folder)).impute_mode().df.select(*ID_LIST, "l_returnflag")


@query(
    "impute_constant",
    f"SELECT {IDS}, coalesce(l_returnflag, 'missing') AS l_returnflag, {r('coalesce(l_quantity, -1)')} AS l_quantity FROM {GAPPY_SQL}",
)
def impute_constant(spark, folder):
    done = Cleaner(gappy(spark, folder)).impute_constant("missing", ["l_returnflag"]).impute_constant(-1, ["l_quantity"])
    return tidy(done.df.select(*ID_LIST, "l_returnflag", "l_quantity"))


@query(
    "impute_constant_fraction",
    f"SELECT {IDS}, {r('coalesce(l_quantity, 0.5)')} AS l_quantity, "
    f"{r('coalesce((CASE WHEN l_partkey % 5 > 0 THEN l_partkey END)::DOUBLE, 0.5)')} AS part FROM {GAPPY_SQL}",
)
def impute_constant_fraction(spark, folder):
    df = gappy(spark, folder).selectExpr("*", "CASE WHEN l_partkey % 5 > 0 THEN l_partkey END AS part")
    done = Cleaner(df).impute_constant(0.5, ["l_quantity", "part"])
    return tidy(done.df.select(*ID_LIST, "l_quantity", "part"))


EVENT_GAPS = "(SELECT event_id, user_id, nullif(event_type, 'view') AS event_type, CASE WHEN value > 20 THEN value END AS value FROM events)"


def event_gaps(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "nullif(event_type, 'view') AS event_type", "CASE WHEN value > 20 THEN value END AS value"
    )


def _ffill(over: str) -> str:
    return (
        f"SELECT event_id, user_id, last_value(event_type IGNORE NULLS) OVER ({over}) AS event_type, "
        + r(f"last_value(value IGNORE NULLS) OVER ({over})")
        + f" AS value FROM {EVENT_GAPS}"
    )


@query("forward_fill_by_event", _ffill("ORDER BY event_id ROWS UNBOUNDED PRECEDING"))
def forward_fill(spark, folder):
    return tidy(Cleaner(event_gaps(spark, folder), ["event_id"]).impute_forward_fill(["event_type", "value"]).df)


@query("forward_fill_spread_over_tasks", _ffill("ORDER BY event_id ROWS UNBOUNDED PRECEDING"))
def forward_fill_pieces(spark, folder):
    step = Cleaner(event_gaps(spark, folder), ["event_id"])
    return tidy(step.impute_forward_fill(["event_type", "value"], rows_per_task=1000).df)


@query("forward_fill_per_user", _ffill("PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING"))
def forward_fill_user(spark, folder):
    step = Cleaner(event_gaps(spark, folder), ["event_id"], ["user_id"])
    return tidy(step.impute_forward_fill(["event_type", "value"]).df)


@query(
    "remove_duplicates_first",
    "SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
)
def duplicates_first(spark, folder):
    return Cleaner(table(spark, folder, "documents"), ["doc_id"]).remove_duplicates(["text"]).df.select("doc_id", "text", "lang")


@query(
    "remove_duplicates_last",
    "SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1",
)
def duplicates_last(spark, folder):
    done = Cleaner(table(spark, folder, "documents"), ["doc_id"]).remove_duplicates(["text", "lang"], keep="last")
    return done.df.select("doc_id", "text", "lang")


@query(
    "remove_duplicates_none_kept",
    "SELECT doc_id, text, lang FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1",
)
def duplicates_none(spark, folder):
    done = Cleaner(table(spark, folder, "documents")).remove_duplicates(["text"], keep=False)
    return done.df.select("doc_id", "text", "lang")


@query("remove_duplicate_rows", "SELECT DISTINCT nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def duplicate_rows(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("nullif(l_returnflag, 'N') AS l_returnflag", "l_linestatus", "l_linenumber")
    return Cleaner(df).remove_duplicates().df


CUBED_SQL = "(SELECT o_orderkey, power(o_totalprice / 1000, 3) AS cubed, nullif(o_totalprice, 0) AS o_totalprice FROM orders)"


def cubed(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "power(o_totalprice / 1000, 3) AS cubed", "nullif(o_totalprice, 0) AS o_totalprice"
    )


def _bounds(c: str) -> str:
    return (
        f"(SELECT {linear(c, 0.25)} - 1.5 * ({linear(c, 0.75)} - {linear(c, 0.25)}) AS lo, "
        f"{linear(c, 0.75)} + 1.5 * ({linear(c, 0.75)} - {linear(c, 0.25)}) AS hi FROM {CUBED_SQL})"
    )


@query(
    "cap_outliers",
    f"SELECT o_orderkey, {r('least(greatest(cubed, b.lo), b.hi)', 2)} AS cubed FROM {CUBED_SQL}, {_bounds('cubed')} AS b",
)
def cap_outliers(spark, folder):
    return tidy(Cleaner(cubed(spark, folder)).cap_outliers_iqr(["cubed"]).df.select("o_orderkey", "cubed"), 2)


@query(
    "remove_outliers",
    f"SELECT o_orderkey, {r('cubed', 2)} AS cubed FROM {CUBED_SQL}, {_bounds('cubed')} AS b, {_bounds('o_totalprice')} AS c "
    "WHERE cubed BETWEEN b.lo AND b.hi AND o_totalprice BETWEEN c.lo AND c.hi",
)
def remove_outliers(spark, folder):
    done = Cleaner(cubed(spark, folder)).remove_outliers_iqr(["cubed", "o_totalprice"])
    return tidy(done.df.select("o_orderkey", "cubed"), 2)


DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    "cast_to_datetime",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, "
    "strftime(o_orderdate, '%Y-%m-%d') AS us_day FROM orders",
)
def cast_datetime(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'P' THEN 'not a date' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day",
        "date_format(o_orderdate, 'M/d/yyyy') AS us_day",
    )
    done = Cleaner(df).cast_to_datetime(["day", "us_day"]).df
    return done.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day", "us_day")])


@query(
    "cast_to_numeric",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {r('o_totalprice', 2)} END AS price, NULL::DOUBLE AS grouped, "
    f"{r('o_custkey', 2)} AS stripped FROM orders",
)
def cast_numeric(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'P' THEN concat(o_totalprice, 'd') ELSE cast(o_totalprice AS STRING) END AS price",
        "concat('1,', cast(o_custkey AS STRING)) AS grouped",
        "concat(',', cast(o_custkey AS STRING)) AS stripped",
    )
    return tidy(Cleaner(df).cast_to_numeric(["price", "grouped"]).cast_to_numeric(["stripped"], strip_commas=True).df, 2)


@query(
    "cast_to_categorical",
    "SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority_code FROM orders",
)
def cast_categorical(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return Cleaner(df).cast_to_categorical(["o_orderpriority"]).df


@query(
    "strip_whitespace",
    "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM "
    "(SELECT doc_id, chr(9) || ' ' || text || chr(10) || ' ' AS text FROM documents)",
)
def strip_whitespace(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("\t "), "text", F.lit("\n ")).alias("text"))
    return Cleaner(df).strip_whitespace().df


@query("to_lowercase", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def to_lowercase(spark, folder):
    return Cleaner(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")).to_lowercase().df


@query("drop_constant_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def drop_constant(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "1 AS one", "CASE WHEN o_orderstatus = 'F' THEN 'x' END AS sometimes",
        "cast(NULL AS STRING) AS never",
    )
    return Cleaner(df).drop_constant_columns().df


@query(
    "rename_snake_case",
    "SELECT o_orderkey AS order_key, o_custkey AS customer_id2, o_orderstatus AS http_status, o_orderpriority AS a_b_c FROM orders",
)
def rename_snake_case(spark, folder):
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderKey"),
        F.col("o_custkey").alias("Customer ID2"),
        F.col("o_orderstatus").alias("HTTPStatus!"),
        F.col("o_orderpriority").alias("_a-b.c"),
    )
    return Cleaner(df).rename_columns_snake_case().df
