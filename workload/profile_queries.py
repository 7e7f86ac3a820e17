"""Profile, quality, type suggestions, comparison."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabulon.operators import compare, insights, profile, quality, types
from tabulon.operators.clean import Cleaner
from workload.common import GAPPY_SQL, LINEITEM_NUMBERS, LINEITEM_OTHERS, exact_r as r, gappy, midpoint, r as plain_r, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def _skew(column: str, source: str) -> str:
    return (
        f"(SELECT (sum(power(v - m, 3)) / count(*)) / power(sum(power(v - m, 2)) / count(*), 1.5) FROM "
        f"(SELECT {column}::DOUBLE AS v, avg({column}::DOUBLE) OVER () AS m FROM {source} WHERE {column} IS NOT NULL))"
    )


def _stats(column: str, source: str) -> str:
    return (
        f"{r(f'(SELECT avg({column}::DOUBLE) FROM {source})')} AS mean, "
        f"{r(midpoint(source, column, 0.5))} AS median, "
        f"{r(f'(SELECT stddev_samp({column}::DOUBLE) FROM {source})')} AS std, "
        f"{r(f'(SELECT min({column}) FROM {source})')} AS min, {r(f'(SELECT max({column}) FROM {source})')} AS max, "
        f"{r(midpoint(source, column, 0.25))} AS q1, {r(midpoint(source, column, 0.75))} AS q3, "
        f"{r(_skew(column, source))} AS skewness"
    )


NUMERIC_STATS_SQL = union(f"SELECT '{c}' AS name, {_stats(c, 'lineitem')}" for c in LINEITEM_NUMBERS)


@query("numeric_stats_lineitem", NUMERIC_STATS_SQL)
def numeric_stats(spark, folder):
    return tidy(profile.numeric_stats(table(spark, folder, "lineitem")))


LINEITEM_WIDTHS = "8 + 8 + 8 + 4 + 8 + 8 + 8 + 8 + strlen(l_returnflag) + strlen(l_linestatus) + 8"


@query(
    "basic_info_lineitem",
    f"""SELECT count(*) AS rows, 11::BIGINT AS columns, sum({LINEITEM_WIDTHS})::BIGINT AS memory_usage_bytes,
        {r(f'sum({LINEITEM_WIDTHS}) / 1048576.0', 2)} AS memory_usage_mb,
        (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)))::BIGINT AS duplicate_rows,
        0::BIGINT AS total_missing FROM lineitem""",
)
def basic_info(spark, folder):
    return tidy(profile.basic_info(table(spark, folder, "lineitem")).drop("column_names", "dtypes_summary"), 2)


@query(
    "duplicate_rows_flags",
    """SELECT count(*) AS rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT nullif(l_returnflag, 'N'),
       l_linestatus, l_quantity, l_discount FROM lineitem)))::BIGINT AS duplicate_rows,
       (sum((l_returnflag = 'N')::INT))::BIGINT AS total_missing FROM lineitem""",
)
def duplicate_rows(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "nullif(l_returnflag, 'N') AS l_returnflag", "l_linestatus", "l_quantity", "l_discount"
    )
    return profile.basic_info(df).select("rows", "duplicate_rows", "total_missing")


def _column_row(c: str, dtype: str, numeric: bool, source: str) -> str:
    stats = _stats(c, source) if numeric else ", ".join(
        f"NULL::DOUBLE AS {s}" for s in ("mean", "median", "std", "min", "max", "q1", "q3", "skewness")
    )
    return (
        f"SELECT '{c}' AS name, '{dtype}' AS dtype, (SELECT count(*) - count({c}) FROM {source}) AS missing_count, "
        f"{r(f'(SELECT (count(*) - count({c})) / count(*)::DOUBLE * 100 FROM {source})', 2)} AS missing_percent, "
        f"(SELECT count(DISTINCT {c}) + max(({c} IS NULL)::INT) FROM {source})::BIGINT AS unique_count, "
        f"{str(numeric).lower()} AS is_numeric, {stats}"
    )


GAPPY_COLUMNS = [
    ("l_orderkey", "bigint", True), ("l_linenumber", "int", True), ("l_partkey", "bigint", True),
    ("l_suppkey", "bigint", True), ("l_quantity", "double", True), ("l_extendedprice", "double", True),
    ("l_discount", "double", True), ("l_returnflag", "string", False), ("l_linestatus", "string", False),
]


@query("column_analysis_gaps", union(_column_row(*c, f"{GAPPY_SQL} AS g") for c in GAPPY_COLUMNS))
def column_analysis(spark, folder):
    return tidy(profile.column_analysis(gappy(spark, folder)))


def _top(c: str, shown: str, source: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", place AS rank, v AS value, n AS count FROM (SELECT coalesce(v, 'None') AS v, n, "
        f"(row_number() OVER (ORDER BY n DESC, v NULLS FIRST))::INT AS place FROM "
        f"(SELECT {shown} AS v, count(*) AS n FROM {source} GROUP BY 1)) WHERE place <= 10"
    )


@query(
    "top_values_orders",
    union(
        [
            _top("o_orderstatus", "o_orderstatus", "(SELECT nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders)"),
            _top("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "orders"),
            _top("o_orderpriority", "o_orderpriority", "orders"),
        ]
    ),
)
def top_values(spark, folder):
    df = table(spark, folder, "orders")
    return profile.top_values(df.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")))


@query("top_values_documents", _top("text", "text", "documents"))
def top_texts(spark, folder):
    return profile.top_values(table(spark, folder, "documents").select("text"))


@query("top_values_long_ties", _top("text", "text", "(SELECT repeat('the same beginning ', 20) || text AS text FROM documents)"))
def top_long_texts(spark, folder):
    """All texts share more than the head that is counted: ties are settled further in."""
    text = F.concat(F.lit("the same beginning " * 20), F.col("text")).alias("text")
    return profile.top_values(table(spark, folder, "documents").select(text))


def _corr(a: str, b: str, source: str) -> str:
    return f"(SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM {source})"


@query(
    "correlation_matrix_lineitem",
    union(
        f"SELECT '{a}' AS column1, '{b}' AS column2, "
        + (f"{r('1.0')}" if a == b else r(f"coalesce({_corr(a, b, 'lineitem')}, 0)"))
        + " AS correlation"
        for a in LINEITEM_NUMBERS
        for b in LINEITEM_NUMBERS
    ),
)
def correlation_matrix(spark, folder):
    return tidy(profile.correlation_matrix(table(spark, folder, "lineitem")))


@query(
    "correlation_constant_column",
    union(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {v} AS correlation"
        for a, b, v in [
            ("l_quantity", "l_quantity", "1.0::DOUBLE"), ("l_quantity", "fixed", "0.0::DOUBLE"),
            ("fixed", "l_quantity", "0.0::DOUBLE"), ("fixed", "fixed", "0.0::DOUBLE"),
        ]
    ),
)
def correlation_constant(spark, folder):
    return tidy(profile.correlation_matrix(table(spark, folder, "lineitem").selectExpr("l_quantity", "0.1D AS fixed")))


def _outlier(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", o AS outlier_count, {r('o / n::DOUBLE * 100', 2)} AS outlier_percent,
        {r('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {r('q3 + 1.5 * (q3 - q1)')} AS upper_bound,
        {r('q1')} AS q1, {r('q3')} AS q3, {r('q3 - q1')} AS iqr FROM (
        SELECT any_value(q1) AS q1, any_value(q3) AS q3, count({c}) AS n,
        count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS o
        FROM {source}, (SELECT {midpoint(source, c, 0.25)} AS q1, {midpoint(source, c, 0.75)} AS q3))"""


SKEWED_SQL = "(SELECT o_totalprice * o_totalprice * o_totalprice AS cubed, o_custkey FROM orders) AS s"
SKEWED = ["o_totalprice * o_totalprice * o_totalprice AS cubed", "o_custkey"]


@query("outliers_lineitem", union(_outlier(c, "lineitem") for c in LINEITEM_NUMBERS))
def outliers(spark, folder):
    return tidy(profile.detect_outliers(table(spark, folder, "lineitem")))


@query(
    "outliers_event_values",
    union(
        [
            _outlier("event_id", "events").replace("FROM events,", "FROM events,"),
            _outlier("user_id", "events"),
            _outlier("value", "events"),
        ]
    ),
)
def outliers_events(spark, folder):
    return tidy(profile.detect_outliers(table(spark, folder, "events")))


def _outlier_total(columns, source) -> str:
    return " + ".join(f"(SELECT outlier_count FROM ({_outlier(c, source)}))" for c in columns)


def _quality_sql(source, numbers, others, strings, distinct_rows) -> str:
    columns = numbers + others
    nulls = " + ".join(f"count(*) - count({c})" for c in columns)
    present = " + ".join(f"count({c})" for c in numbers)

    def kinds(c):
        return f"(count(DISTINCT {c}) + max(({c} IS NULL)::INT))"

    low = " + ".join(f"({kinds(c)} / count(*)::DOUBLE < 0.05)::INT" for c in strings) or "0"
    constant = " + ".join(f"({kinds(c)} <= 1)::INT" for c in columns)
    k = len(columns)
    return f"""WITH f AS (SELECT count(*) AS n, ({nulls}) AS nulls, ({present}) AS present, ({low}) AS low,
        ({constant}) AS constant FROM {source}),
        s AS (SELECT greatest(0, 100 - nulls / (n * {k})::DOUBLE * 100 * 2) AS missing_data,
        greatest(0, 100 - (n - (SELECT count(*) FROM (SELECT DISTINCT {distinct_rows} FROM {source}))) / n::DOUBLE * 100 * 3)
        AS duplicates,
        greatest(0, 100 - ({_outlier_total(numbers, source)}) / present::DOUBLE * 100 * 5) AS outliers,
        greatest(0, 100 - low / {k}::DOUBLE * 100 * 2) AS type_consistency,
        greatest(0, 100 - constant / {k}::DOUBLE * 100 * 10) AS unique_ratios FROM f),
        t AS (SELECT *, missing_data * 0.3 + duplicates * 0.2 + outliers * 0.2 + type_consistency * 0.15
        + unique_ratios * 0.15 AS overall FROM s)"""


QUALITY_COLUMNS = ["missing_data", "duplicates", "outliers", "type_consistency", "unique_ratios"]
SCORE_SELECT = (
    f"SELECT {r('overall', 1)} AS overall_score, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' "
    "WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade, "
    + ", ".join(f"{r(c, 1)} AS {c}" for c in QUALITY_COLUMNS)
    + " FROM t"
)
GAPPY_NUMBERS = [c for c, _, numeric in GAPPY_COLUMNS if numeric]
GAPPY_QUALITY = _quality_sql(
    f"{GAPPY_SQL} AS g", GAPPY_NUMBERS, ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"], "*"
)
LINEITEM_QUALITY = _quality_sql("lineitem", LINEITEM_NUMBERS, LINEITEM_OTHERS, LINEITEM_OTHERS[:2], "*")


@query("quality_score_lineitem", f"{LINEITEM_QUALITY} {SCORE_SELECT}")
def quality_score(spark, folder):
    return tidy(quality.quality_score(table(spark, folder, "lineitem")), 1)


@query("quality_score_gaps", f"{GAPPY_QUALITY} {SCORE_SELECT}")
def quality_score_gaps(spark, folder):
    return tidy(quality.quality_score(gappy(spark, folder)), 1)


FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]
FLAG_SQL = "(SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, 1 AS fixed FROM lineitem) AS g"
FLAG_QUALITY = _quality_sql(
    FLAG_SQL, ["l_linenumber", "l_discount", "fixed"], FLAGS[:2], FLAGS[:2], "*"
)


def flags(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*FLAGS, "1 AS fixed")


@query(
    "quality_breakdown_flags",
    FLAG_QUALITY
    + " "
    + union(
        f"SELECT '{c}' AS dimension, {r(c, 1)} AS score, {w}::DOUBLE AS weight FROM t"
        for c, w in zip(QUALITY_COLUMNS, (0.3, 0.2, 0.2, 0.15, 0.15))
    ),
)
def quality_breakdown(spark, folder):
    return tidy(quality.quality_breakdown(flags(spark, folder)).drop("details"), 2)


@query(
    "quality_grades_by_table",
    f"WITH q1 AS ({LINEITEM_QUALITY} {SCORE_SELECT}), q2 AS ({FLAG_QUALITY} {SCORE_SELECT}) "
    "SELECT 'lineitem' AS name, grade FROM q1 UNION ALL SELECT 'flags', grade FROM q2",
)
def quality_grades(spark, folder):
    first = quality.quality_score(table(spark, folder, "lineitem")).select(F.lit("lineitem").alias("name"), "grade")
    return first.unionByName(quality.quality_score(flags(spark, folder)).select(F.lit("flags").alias("name"), "grade"))


@query(
    "quality_recommendations_flags",
    FLAG_QUALITY
    + """, rules AS (SELECT 'missing_data' AS rule FROM t WHERE missing_data < 80
        UNION ALL SELECT 'duplicates' FROM t WHERE duplicates < 90
        UNION ALL SELECT 'outliers' FROM t WHERE outliers < 80
        UNION ALL SELECT 'type_consistency' FROM t WHERE type_consistency < 80
        UNION ALL SELECT 'unique_ratios' FROM t WHERE unique_ratios < 100)
        SELECT rule FROM rules UNION ALL SELECT 'excellent' WHERE (SELECT count(*) FROM rules) = 0""",
)
def quality_recommendations(spark, folder):
    return quality.recommendations(flags(spark, folder)).select("rule")


RADAR = ["Missing Data", "Duplicates", "Outliers", "Type Consistency", "Unique Ratios", "Missing Data"]


@query(
    "quality_radar_flags",
    FLAG_QUALITY
    + " "
    + union(
        f"SELECT {i} AS point, '{label}' AS dimension, {r(QUALITY_COLUMNS[i % 5], 1)} AS score FROM t"
        for i, label in enumerate(RADAR)
    ),
)
def quality_radar(spark, folder):
    return tidy(quality.quality_radar(flags(spark, folder)), 1)


PARSE_SQL = """(SELECT strftime(o_orderdate, '%Y-%m-%d') AS day_text, o_totalprice::DECIMAL(18,2)::VARCHAR AS price_text,
    o_custkey::VARCHAR AS key_text, o_orderpriority, o_orderkey FROM orders) AS p"""


def parse_frame(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day_text", "cast(cast(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price_text",
        "cast(o_custkey AS STRING) AS key_text", "o_orderpriority", "o_orderkey",
    )


def _suggest(c: str, pattern: str, share: float, kind: str) -> str:
    return f"""SELECT '{c}' AS "column", {kind} AS suggested_type, {r('hits / n::DOUBLE * 100', 1)} AS confidence FROM (
        SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(v, '{pattern}')) AS hits,
        count(*) FILTER (WHERE contains(v, '.')) AS dots FROM (SELECT {c} AS v FROM {PARSE_SQL}))
        WHERE hits / n::DOUBLE > {share}"""


@query(
    "datetime_suggestions_orders",
    union(
        _suggest(c, r"^\d{4}-\d{2}-\d{2}$", 0.8, "'datetime'")
        for c in ("day_text", "price_text", "key_text", "o_orderpriority")
    ),
)
def datetime_suggestions(spark, folder):
    with profile.TableProfile(parse_frame(spark, folder), order_by=["o_orderkey"]) as p:
        return tidy(types.detect_datetime(p).select("column", "suggested_type", "confidence"), 1)


@query(
    "numeric_text_suggestions_orders",
    union(
        _suggest(c, r"^[0-9,]+(\.[0-9]+)?$", 0.95, "CASE WHEN dots > 0 THEN 'float64' ELSE 'int64' END")
        for c in ("day_text", "price_text", "key_text", "o_orderpriority")
    ),
)
def numeric_suggestions(spark, folder):
    with profile.TableProfile(parse_frame(spark, folder), order_by=["o_orderkey"]) as p:
        return tidy(types.detect_numeric_strings(p).select("column", "suggested_type", "confidence"), 1)


def _category(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
        {r(f'count(DISTINCT {c}) / count(*)::DOUBLE * 100', 2)} AS unique_ratio,
        {r(f'greatest(0, (sum(strlen({c})) - (2 * count(*) + 50 * count(DISTINCT {c}))) / 1048576.0)', 2)} AS memory_savings_mb
        FROM {t} HAVING count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) / count(*)::DOUBLE < 0.05"""


@query("categorical_suggestions_part", union(_category(c, "part") for c in ("p_name", "p_brand", "p_type")))
def categorical_suggestions(spark, folder):
    found = types.detect_categorical(table(spark, folder, "part"))
    return tidy(found.select("column", "unique_count", "unique_ratio", "memory_savings_mb"), 2)


@query("categorical_savings_documents", union(_category(c, "documents") for c in ("text", "lang", "source")))
def categorical_savings(spark, folder):
    found = types.detect_categorical(table(spark, folder, "documents"))
    return tidy(found.select("column", "unique_count", "unique_ratio", "memory_savings_mb"), 2)


@query(
    "boolean_suggestions_lineitem",
    """SELECT 'taxed' AS "column", 'bool' AS suggested_type, 'No,Yes' AS "values" FROM lineitem
       HAVING count(DISTINCT CASE WHEN l_tax > 0 THEN 'Yes' ELSE 'No' END) = 2""",
)
def boolean_suggestions(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "CASE WHEN l_tax > 0 THEN 'Yes' ELSE 'No' END AS taxed", "l_linestatus", "l_returnflag"
    )
    found = types.detect_boolean(df)
    return found.select("column", "suggested_type", F.concat_ws(",", "values").alias("values"))


@query(
    "schema_diff_customer_supplier",
    """SELECT 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS first_only,
       's_acctbal,s_name,s_nationkey,s_suppkey' AS second_only, '' AS common,
       ((SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier))::BIGINT AS row_count_diff,
       1::BIGINT AS column_count_diff""",
)
def schema_diff(spark, folder):
    found = compare.schema_diff(table(spark, folder, "customer"), table(spark, folder, "supplier"))
    lists = [F.concat_ws(",", c).alias(c) for c in ("first_only", "second_only", "common")]
    return found.select(*lists, "row_count_diff", "column_count_diff")


def _side(c: str, t: str, tag: str, dtype: str, numeric: bool) -> str:
    mean = r(f"avg({c})") if numeric else "NULL::DOUBLE"
    std = r(f"stddev_samp({c})") if numeric else "NULL::DOUBLE"
    return (
        f"'{dtype}' AS dtype_{tag}, count(*) - count({c}) AS missing_count_{tag}, count(DISTINCT {c}) AS unique_count_{tag}, "
        f"{mean} AS mean_{tag}, {std} AS std_{tag}"
    )


COMPARED = [("name", "string", False), ("nationkey", "int", True), ("acctbal", "double", True)]


@query(
    "compare_customer_supplier",
    union(
        f"SELECT '{c}' AS name, a.*, b.*, 'common' AS presence FROM "
        f"(SELECT {_side('c_' + c, 'customer', '1', d, n)} FROM customer) a, "
        f"(SELECT {_side('s_' + c, 'supplier', '2', d, n)} FROM supplier) b"
        for c, d, n in COMPARED
    ),
)
def compare_tables(spark, folder):
    def renamed(name, prefix):
        df = table(spark, folder, name)
        return df.select(*[F.col(prefix + c).alias(c) for c, _, _ in COMPARED])

    return tidy(compare.compare(renamed("customer", "c_"), renamed("supplier", "s_")))


@query(
    "full_report_gaps",
    f"""{GAPPY_QUALITY}, q AS ({SCORE_SELECT}) SELECT count(*) AS rows, 9::BIGINT AS columns,
        (sum(8 + 4 + 8 + 8 + 8 + 8 + 8 + coalesce(strlen(l_returnflag), 0) + strlen(l_linestatus)))::BIGINT AS memory_usage_bytes,
        (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {GAPPY_SQL})))::BIGINT AS duplicate_rows,
        (count(*) * 3 - count(l_quantity) - count(l_discount) - count(l_returnflag))::BIGINT AS total_missing,
        any_value(q.overall_score) AS overall_score, any_value(q.grade) AS grade FROM {GAPPY_SQL} AS g, q""",
)
def full_report(spark, folder):
    report = compare.full_report(gappy(spark, folder), order_by=["l_orderkey", "l_linenumber"])
    facts = report.basic_info.drop("column_names", "dtypes_summary", "memory_usage_mb")
    score = report.quality_score.first()
    return tidy(facts.withColumns({"overall_score": F.lit(score["overall_score"]), "grade": F.lit(score["grade"])}), 1)


HISTORY_SQL = """(SELECT o_custkey::VARCHAR AS dataset_id, o_orderkey AS version, o_totalprice FROM orders)"""


@query(
    "profile_history_latest",
    f"""SELECT dataset_id, version, {plain_r('o_totalprice', 2)} AS o_totalprice FROM (SELECT *, row_number() OVER
        (PARTITION BY dataset_id ORDER BY version DESC) AS n FROM {HISTORY_SQL}) WHERE n = 1""",
)
def profile_history_latest(spark, folder):
    history = table(spark, folder, "orders").selectExpr(
        "cast(o_custkey AS STRING) AS dataset_id", "o_orderkey AS version", "o_totalprice"
    )
    return tidy(compare.latest_profiles(history), 2)


@query(
    "profile_history_versions",
    """SELECT 'orders' AS dataset_id, v AS version, count(*) AS rows FROM orders, (VALUES (1::BIGINT), (2::BIGINT)) AS t(v)
       GROUP BY v""",
)
def profile_history_versions(spark, folder):
    from workload.common import scratch

    path = scratch(spark, "history")
    report = compare.full_report(table(spark, folder, "orders"), order_by=["o_orderkey"])
    compare.append_profile(report, path, "orders")
    compare.append_profile(report, path, "orders")
    return compare.profile_history(spark, path, "orders").select("dataset_id", "version", "rows")


DERIVED_SQL = """(SELECT l_quantity, l_quantity * l_extendedprice AS revenue, l_extendedprice, l_quantity * 2 + l_tax AS doubled,
    l_discount FROM lineitem) AS d"""
DERIVED = ["l_quantity", "l_quantity * l_extendedprice AS revenue", "l_extendedprice", "l_quantity * 2 + l_tax AS doubled", "l_discount"]
DERIVED_NAMES = ["l_quantity", "revenue", "l_extendedprice", "doubled", "l_discount"]


@query(
    "ranked_correlations_derived",
    """WITH p AS ("""
    + union(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {r(_corr(a, b, DERIVED_SQL))} AS correlation"
        for a, b in combinations(DERIVED_NAMES, 2)
    )
    + """) SELECT column1, column2, correlation, CASE WHEN abs(correlation) >= 0.8 THEN 'very strongly'
        WHEN abs(correlation) >= 0.6 THEN 'strongly' WHEN abs(correlation) >= 0.4 THEN 'moderately' ELSE 'weakly' END AS strength,
        CASE WHEN correlation >= 0 THEN 'together' ELSE 'opposite' END AS direction, abs(correlation) >= 0.7 AS strong
        FROM p WHERE abs(correlation) >= 0.1""",
)
def ranked_correlations(spark, folder):
    return tidy(profile.ranked_correlations(table(spark, folder, "lineitem").selectExpr(*DERIVED), 0.1))


@query(
    "outlier_summary_skewed",
    "WITH o AS ("
    + union(_outlier(c, SKEWED_SQL) for c in ("cubed", "o_custkey"))
    + """) SELECT "column", outlier_count, outlier_percent, CASE WHEN outlier_percent = 0 THEN 'none' WHEN outlier_percent < 2
        THEN 'low' WHEN outlier_percent < 5 THEN 'moderate' ELSE 'high' END AS severity,
        (sum(outlier_count) OVER ())::BIGINT AS total_outliers,
        (sum((outlier_count > 0)::INT) OVER ())::INT AS columns_affected FROM o""",
)
def outlier_summary(spark, folder):
    return tidy(profile.outlier_summary(table(spark, folder, "orders").selectExpr(*SKEWED)), 2)


@query(
    "insights_flags",
    f"""{FLAG_QUALITY} SELECT 'missing_cells' AS rule, 'success' AS level, {r('0', 1)} AS measure
        UNION ALL SELECT 'duplicate_rows', 'warning', {r('(100 - 0) * 0 + (SELECT (n - (SELECT count(*) FROM (SELECT DISTINCT * FROM ' + FLAG_SQL + '))) / n::DOUBLE * 100 FROM f)', 1)}
        UNION ALL SELECT 'outlier_columns', 'success', 0.0
        UNION ALL SELECT 'low_cardinality_numbers', 'info', ((count(DISTINCT l_linenumber) <= 10)::INT +
        (count(DISTINCT l_discount) <= 10)::INT + 1)::DOUBLE FROM lineitem
        UNION ALL SELECT 'constant_columns', 'danger', 1.0""",
)
def insights_flags(spark, folder):
    return tidy(insights.insights(flags(spark, folder)).select("rule", "level", "measure"), 1)


@query(
    "cleaning_suggestions_gaps",
    f"""WITH m AS (SELECT 'l_quantity' AS c, 'mean' AS how, count(*) - count(l_quantity) AS k, count(*) AS n FROM {GAPPY_SQL}
        UNION ALL SELECT 'l_discount', 'mean', count(*) - count(l_discount), count(*) FROM {GAPPY_SQL}
        UNION ALL SELECT 'l_returnflag', 'mode', count(*) - count(l_returnflag), count(*) FROM {GAPPY_SQL})
        SELECT 'impute-' || c AS id, CASE WHEN k / n::DOUBLE > 0.3 THEN 'high' ELSE 'medium' END AS priority,
        'missing_data' AS category, c AS "column", k AS estimated_rows_affected FROM m WHERE k / n::DOUBLE > 0.05""",
)
def cleaning_suggestions(spark, folder):
    with profile.TableProfile(gappy(spark, folder), order_by=["l_orderkey", "l_linenumber"]) as p:
        found = insights.cleaning_suggestions(p)
    return found.select("id", "priority", "category", "column", "estimated_rows_affected")


@query(
    "apply_suggestions_gaps",
    f"""SELECT l_orderkey, l_linenumber, {plain_r('coalesce(l_quantity, (SELECT avg(l_quantity) FROM ' + GAPPY_SQL + '))')} AS l_quantity,
        {plain_r('coalesce(l_discount, (SELECT avg(l_discount) FROM ' + GAPPY_SQL + '))')} AS l_discount,
        coalesce(l_returnflag, (SELECT l_returnflag FROM {GAPPY_SQL} WHERE l_returnflag IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM {GAPPY_SQL}""",
)
def apply_suggestions(spark, folder):
    steps = [
        {"impute_numeric": "mean", "impute_numeric_columns": ["l_quantity", "l_discount"]},
        {"impute_categorical": "mode", "impute_categorical_columns": ["l_returnflag"]},
    ]
    done = insights.apply_suggestions(gappy(spark, folder), steps)
    return tidy(done.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"))


@query(
    "cleaner_summary_gaps",
    f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
        AND l_returnflag IS NOT NULL) AS rows_after, count(*) FILTER (WHERE l_quantity IS NULL OR l_discount IS NULL
        OR l_returnflag IS NULL) AS rows_removed, 9::BIGINT AS cols_before, 9::BIGINT AS cols_after, 0::BIGINT AS cols_removed
        FROM {GAPPY_SQL}""",
)
def cleaner_summary(spark, folder):
    return Cleaner(gappy(spark, folder)).drop_missing_rows().summary().drop("cleaning_log")
