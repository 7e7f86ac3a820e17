"""Feature engineering on orders, lineitem, events, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators.features import Features
from workload.common import r, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


@query(
    "log_transform",
    f"SELECT c_custkey, {r('ln(1 + c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END FROM customer))')} "
    f"AS c_acctbal_log, {r('ln(1 + c_custkey + 1)')} AS c_custkey_log FROM customer",
)
def log_transform(spark, folder):
    done = Features(table(spark, folder, "customer")).log_transform(["c_acctbal", "c_custkey"])
    return tidy(done.df.select("c_custkey", "c_acctbal_log", "c_custkey_log"))


@query("log_transform_plain", f"SELECT o_orderkey, {r('ln(o_totalprice)')} AS o_totalprice_log FROM orders")
def log_plain(spark, folder):
    done = Features(table(spark, folder, "orders")).log_transform(["o_totalprice"], handle_zeros=False)
    return tidy(done.df.select("o_orderkey", "o_totalprice_log"))


@query(
    "normalize_minmax",
    "SELECT o_orderkey, "
    + r("(o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)", 6)
    + " AS o_totalprice_norm, 0.0::DOUBLE AS one_norm FROM orders",
)
def normalize(spark, folder):
    done = Features(table(spark, folder, "orders").withColumn("one", F.lit(1))).normalize_minmax(["o_totalprice", "one"])
    return tidy(done.df.select("o_orderkey", "o_totalprice_norm", "one_norm"), 6)


@query(
    "standardize_zscore",
    "SELECT o_orderkey, "
    + r("(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)", 6)
    + " AS o_totalprice_std FROM orders",
)
def standardize(spark, folder):
    done = Features(table(spark, folder, "orders")).standardize_zscore(["o_totalprice"])
    return tidy(done.df.select("o_orderkey", "o_totalprice_std"), 6)


WIDTH = "((SELECT max(p_retailprice) - min(p_retailprice) FROM part) / 4)"


@query(
    "bin_equal_width",
    f"""SELECT p_partkey, ['low', 'mid', 'high', 'top'][greatest(1, ceil((p_retailprice - (SELECT min(p_retailprice) FROM part))
        / {WIDTH}))::INT] AS p_retailprice_bin FROM part""",
)
def equal_width(spark, folder):
    done = Features(table(spark, folder, "part")).bin_equal_width("p_retailprice", 4, ["low", "mid", "high", "top"])
    return done.df.select("p_partkey", "p_retailprice_bin")


@query(
    "bin_equal_width_intervals",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10.8 THEN '(0.951, 10.8]' WHEN l_quantity <= 20.6 THEN '(10.8, 20.6]'
       WHEN l_quantity <= 30.4 THEN '(20.6, 30.4]' WHEN l_quantity <= 40.2 THEN '(30.4, 40.2]' ELSE '(40.2, 50.0]' END
       AS l_quantity_bin FROM lineitem""",
)
def equal_width_intervals(spark, folder):
    return Features(table(spark, folder, "lineitem")).bin_equal_width("l_quantity").df.select("l_orderkey", "l_linenumber", "l_quantity_bin")


QUINTILES = " + ".join(
    f"(o_totalprice > (SELECT quantile_cont(o_totalprice, {q}) FROM orders))::INT" for q in (0.2, 0.4, 0.6, 0.8)
)


@query("bin_equal_frequency", f"SELECT o_orderkey, ({QUINTILES})::INT AS o_totalprice_qbin FROM orders")
def equal_frequency(spark, folder):
    return Features(table(spark, folder, "orders")).bin_equal_frequency("o_totalprice").df.select("o_orderkey", "o_totalprice_qbin")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "one_hot_encode",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"coalesce(nullif(l_returnflag, 'N') = '{v}', false) AS l_returnflag_{v}" for v in ("A", "R"))
    + " FROM lineitem",
)
def one_hot(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "nullif(l_returnflag, 'N') AS l_returnflag", "l_extendedprice"
    )
    done = Features(df).one_hot_encode(["l_returnflag", "l_extendedprice"])
    return done.df.drop("l_returnflag", "l_extendedprice")


@query(
    "label_encode",
    "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::INT AS p_name_enc, coalesce(CASE WHEN p_type <> 'PROMO' THEN "
    "(SELECT count(DISTINCT q.p_type) FROM part q WHERE q.p_type < part.p_type AND q.p_type <> 'PROMO') END, -1)::INT AS p_type_enc FROM part",
)
def label_encode(spark, folder):
    df = table(spark, folder, "part").withColumn("p_type", F.expr("nullif(p_type, 'PROMO')"))
    return Features(df).label_encode(["p_name", "p_type"]).df.select("p_partkey", "p_name_enc", "p_type_enc")


@query(
    "label_encode_many_values",
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_totalprice) - 1)::INT AS o_totalprice_enc FROM orders",
)
def label_encode_many(spark, folder):
    done = Features(table(spark, folder, "orders")).label_encode(["o_totalprice"], rows_per_task=2000)
    return done.df.select("o_orderkey", "o_totalprice_enc")


@query(
    "datetime_features",
    "SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, "
    "(isodow(ts) - 1)::INT AS ts_dayofweek, hour(ts)::INT AS ts_hour FROM events",
)
def datetime_features(spark, folder):
    return Features(table(spark, folder, "events").select("event_id", "ts")).extract_datetime_features(["ts"]).df.drop("ts")


@query("interaction_product", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('l_quantity * l_extendedprice', 2)} AS l_quantity_x_l_extendedprice FROM lineitem")
def product(spark, folder):
    done = Features(table(spark, folder, "lineitem")).interaction_product("l_quantity", "l_extendedprice")
    return tidy(done.df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_x_l_extendedprice"), 2)


@query("interaction_ratio", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('l_tax / nullif(l_discount, 0)')} AS l_tax_div_l_discount FROM lineitem")
def ratio(spark, folder):
    done = Features(table(spark, folder, "lineitem")).interaction_ratio("l_tax", "l_discount")
    return tidy(done.df.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax_div_l_discount"))


def _rolling(over: str) -> str:
    return (
        f"SELECT event_id, {r(f'avg(value) OVER ({over} ROWS 4 PRECEDING)')} AS value_roll_mean_5, "
        f"{r(f'stddev_samp(value) OVER ({over} ROWS 4 PRECEDING)', 3)} AS value_roll_std_5 FROM events"
    )


def _rolled(spark, folder, **options):
    done = Features(table(spark, folder, "events"), ["event_id"]).rolling_stats("value", 5, **options)
    df = done.df.select("event_id", "value_roll_mean_5", F.round("value_roll_std_5", 3).alias("value_roll_std_5"))
    return tidy(df)


@query("rolling_stats", _rolling("ORDER BY event_id"))
def rolling(spark, folder):
    return _rolled(spark, folder)


@query("rolling_stats_spread_over_tasks", _rolling("ORDER BY event_id"))
def rolling_pieces(spark, folder):
    return _rolled(spark, folder, rows_per_task=1000)


@query("rolling_stats_per_type", _rolling("PARTITION BY event_type ORDER BY event_id"))
def rolling_type(spark, folder):
    return _rolled(spark, folder, partition_by=["event_type"])


def _lags(over: str) -> str:
    return "SELECT event_id, " + ", ".join(
        f"{r(f'lag(value, {k}) OVER ({over})')} AS value_lag{k}" for k in (1, 2, 3)
    ) + " FROM events"


@query("lag_features", _lags("ORDER BY event_id"))
def lags(spark, folder):
    done = Features(table(spark, folder, "events"), ["event_id"]).lag_features("value")
    return tidy(done.df.select("event_id", "value_lag1", "value_lag2", "value_lag3"))


@query("lag_features_spread_over_tasks", _lags("PARTITION BY event_type ORDER BY event_id"))
def lags_pieces(spark, folder):
    done = Features(table(spark, folder, "events"), ["event_id"], ["event_type"]).lag_features("value", rows_per_task=500)
    return tidy(done.df.select("event_id", "value_lag1", "value_lag2", "value_lag3"))


@query(
    "lag_features_hot_key",
    """SELECT o_orderstatus, before, count(*) AS n FROM (
         SELECT o_orderstatus, lag(o_orderstatus, 2) OVER (ORDER BY o_orderstatus) AS before FROM orders)
       GROUP BY ALL""",
)
def lags_hot(spark, folder):
    """Two of three order keys fill nearly the whole table; its rows are spread all the same."""
    slim = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey")
    done = Features(slim, ["o_orderstatus"]).lag_features("o_orderstatus", [2], rows_per_task=300)
    return done.df.groupBy("o_orderstatus", F.col("o_orderstatus_lag2").alias("before")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_summary",
    "SELECT 'c_acctbal_norm,c_acctbal_std' AS new_columns, 7::BIGINT AS total_columns FROM customer HAVING count(*) > 0",
)
def feature_summary(spark, folder):
    done = Features(table(spark, folder, "customer")).normalize_minmax(["c_acctbal"]).standardize_zscore(["c_acctbal"])
    return done.summary().select(F.concat_ws(",", "new_columns").alias("new_columns"), "total_columns")
