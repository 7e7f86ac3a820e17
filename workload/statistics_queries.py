"""Tests, regressions, cohorts and series. The SQL covers what SQL can say; p-values
are checked in the tests against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import cohort as cohorts, hypothesis_tests as tests, regression, timeseries
from workload.common import GAPPY_SQL, LINEITEM_NUMBERS, gappy, r, table, tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


TWO = "(SELECT nullif(l_quantity, 25.0) AS a, l_linenumber AS b FROM lineitem)"


def two(spark, folder):
    return table(spark, folder, "lineitem").selectExpr("nullif(l_quantity, 25.0D) AS a", "l_linenumber AS b")


@query(
    "welch_t_test",
    f"""SELECT {r('(avg(a) - avg(b)) / sqrt(var_samp(a) / count(a) + var_samp(b) / count(b))')} AS statistic,
        {r('power(var_samp(a) / count(a) + var_samp(b) / count(b), 2) / (power(var_samp(a) / count(a), 2) / (count(a) - 1) + power(var_samp(b) / count(b), 2) / (count(b) - 1))')}
        AS degrees_of_freedom, {r('avg(a)')} AS mean1, {r('avg(b)')} AS mean2, {r('stddev_samp(a)')} AS std1,
        {r('stddev_samp(b)')} AS std2, count(a) AS n1, count(b) AS n2 FROM {TWO}""",
)
def t_test(spark, folder):
    found = tests.t_test(two(spark, folder), "a", "b")
    return tidy(found.select("statistic", "degrees_of_freedom", "mean1", "mean2", "std1", "std2", "n1", "n2"))


@query(
    "pooled_t_test",
    f"""SELECT {r('(avg(a) - avg(b)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2) * (1.0 / count(a) + 1.0 / count(b)))')}
        AS statistic, {r('count(a) + count(b) - 2')} AS degrees_of_freedom FROM {TWO}""",
)
def pooled(spark, folder):
    return tidy(tests.t_test(two(spark, folder), "a", "b", equal_var=True).select("statistic", "degrees_of_freedom"))


@query(
    "mann_whitney_exact",
    f"""WITH x AS (SELECT r_regionkey * 6.37 + 0.1 AS v FROM region), y AS (SELECT n_nationkey::DOUBLE AS v FROM nation),
        u AS (SELECT count(*) FILTER (WHERE x.v > y.v) AS u FROM x, y), i AS (SELECT unnest(range(1, 31)) AS k),
        orders AS (SELECT a.k + b.k + c.k + d.k + e.k - 15 AS u FROM i a JOIN i b ON a.k < b.k JOIN i c ON b.k < c.k JOIN i d ON c.k < d.k JOIN i e ON d.k < e.k)
        SELECT u::DOUBLE AS u_statistic, {r("least(1.0, 2.0 * (SELECT count(*) FILTER (WHERE orders.u >= greatest(t.u, 125 - t.u)) / count(*) FROM orders))", 9)} AS p_value,
        'exact' AS method FROM u t""",
)
def mann_whitney_exact(spark, folder):
    few = table(spark, folder, "region").select((F.col("r_regionkey") * 6.37 + 0.1).alias("a"), F.lit(None).cast("double").alias("b"))
    many = table(spark, folder, "nation").select(F.lit(None).cast("double").alias("a"), F.col("n_nationkey").cast("double").alias("b"))
    return tidy(tests.mann_whitney_u(few.unionByName(many), "a", "b").select("u_statistic", "p_value", "method"), 9)


@query(
    "mann_whitney_u",
    f"""WITH v AS (SELECT 0 AS s, a::DOUBLE AS x FROM {TWO} WHERE a IS NOT NULL UNION ALL SELECT 1, b::DOUBLE FROM {TWO}),
        k AS (SELECT s, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM v)
        SELECT {r('sum(rk) FILTER (WHERE s = 0) - count(*) FILTER (WHERE s = 0) * (count(*) FILTER (WHERE s = 0) + 1) / 2.0', 1)} AS u_statistic,
        (SELECT median(a) FROM {TWO}) AS median1, (SELECT median(b)::DOUBLE FROM {TWO}) AS median2,
        count(*) FILTER (WHERE s = 0) AS n1, count(*) FILTER (WHERE s = 1) AS n2 FROM k""",
)
def mann_whitney(spark, folder):
    found = tests.mann_whitney_u(two(spark, folder), "a", "b")
    return tidy(found.select("u_statistic", "median1", "median2", "n1", "n2"), 1)


@query(
    "chi_square_brand_type",
    f"""WITH o AS (SELECT p_brand AS a, p_type AS b, count(*) AS o FROM part GROUP BY 1, 2),
        ra AS (SELECT a, sum(o) AS t FROM o GROUP BY 1), cb AS (SELECT b, sum(o) AS t FROM o GROUP BY 1)
        SELECT {r('sum(power(coalesce(o, 0) - ra.t * cb.t / n::DOUBLE, 2) / (ra.t * cb.t / n::DOUBLE))')} AS chi2_statistic,
        ((count(DISTINCT ra.a) - 1) * (count(DISTINCT cb.b) - 1))::BIGINT AS degrees_of_freedom, any_value(n)::BIGINT AS n
        FROM ra, cb, (SELECT sum(o) AS n FROM o) LEFT JOIN o ON o.a = ra.a AND o.b = cb.b""",
)
def chi_square(spark, folder):
    found = tests.chi_square(table(spark, folder, "part"), "p_brand", "p_type")
    return tidy(found.select("chi2_statistic", "degrees_of_freedom", "n"))


@query(
    "chi_square_many_categories",
    f"""WITH o AS (SELECT o_custkey AS a, o_orderdate AS b, count(*) AS o FROM orders GROUP BY 1, 2),
        ra AS (SELECT a, sum(o) AS t FROM o GROUP BY 1), cb AS (SELECT b, sum(o) AS t FROM o GROUP BY 1)
        SELECT {r('any_value(n) * (sum(o * o / (ra.t * cb.t)::DOUBLE) - 1)', 2)} AS chi2_statistic,
        ((count(DISTINCT ra.a) - 1) * (count(DISTINCT cb.b) - 1))::BIGINT AS degrees_of_freedom, any_value(n)::BIGINT AS n
        FROM o JOIN ra USING (a) JOIN cb USING (b), (SELECT sum(o) AS n FROM o)""",
)
def chi_square_many(spark, folder):
    found = tests.chi_square(table(spark, folder, "orders"), "o_custkey", "o_orderdate")
    return tidy(found.select("chi2_statistic", "degrees_of_freedom", "n"), 2)


@query(
    "chi_square_yates_labels",
    f"""WITH o AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels GROUP BY 1, 2),
        ra AS (SELECT a, sum(o) AS t FROM o GROUP BY 1), cb AS (SELECT b, sum(o) AS t FROM o GROUP BY 1),
        e AS (SELECT coalesce(o, 0) AS o, ra.t * cb.t / n::DOUBLE AS e FROM ra, cb, (SELECT sum(o) AS n FROM o) LEFT JOIN o
        ON o.a = ra.a AND o.b = cb.b) SELECT {r('sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e)')} AS chi2_statistic,
        1::BIGINT AS degrees_of_freedom FROM e""",
)
def chi_square_yates(spark, folder):
    found = tests.chi_square(table(spark, folder, "labels"), "quality", "toxic")
    return tidy(found.select("chi2_statistic", "degrees_of_freedom"))


@query(
    "contingency_flag_status",
    f"""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2)
        SELECT a AS category1, b AS category2, o AS observed,
        {r('sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER ()')} AS expected FROM o""",
)
def contingency(spark, folder):
    return tidy(tests.contingency(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus"))


MOMENTS = "(SELECT count(*) AS n, avg({x}) AS mx, avg({y}) AS my, covar_pop({y}, {x}) AS c, var_pop({x}) AS vx, var_pop({y}) AS vy FROM {t})"
LINE = MOMENTS.format(x="l_quantity", y="l_quantity * l_extendedprice", t="lineitem")


@query(
    "linear_regression_revenue",
    f"""SELECT {r('c / vx')} AS slope, {r('my - c / vx * mx', 3)} AS intercept, {r('c * c / (vx * vy)', 6)} AS r_squared,
        {r('sqrt(vy - c * c / vx)', 3)} AS rmse, {r('c / sqrt(vx * vy)', 6)} AS correlation, n AS n_samples FROM {LINE}""",
)
def linear(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_quantity", "l_quantity * l_extendedprice AS revenue")
    f = regression.linear_regression(df, "l_quantity", "revenue")
    digits = {"slope": 4, "intercept": 3, "r_squared": 6, "rmse": 3, "correlation": 6}
    return f.select(*[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()], "n_samples")


# Quadratic least squares from power sums of the centred predictor, by Cramer's rule.
QUADRATIC = """WITH z AS (SELECT l_quantity - 25 AS x, l_quantity * l_extendedprice / 1000 AS y FROM lineitem),
    s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x1, sum(x*x) AS x2, sum(x*x*x) AS x3, sum(x*x*x*x) AS x4,
    sum(y) AS y0, sum(x*y) AS y1, sum(x*x*y) AS y2 FROM z),
    d AS (SELECT *, n*(x2*x4-x3*x3) - x1*(x1*x4-x3*x2) + x2*(x1*x3-x2*x2) AS det FROM s),
    k AS (SELECT (y0*(x2*x4-x3*x3) - x1*(y1*x4-x3*y2) + x2*(y1*x3-x2*y2))/det AS a,
    (n*(y1*x4-x3*y2) - y0*(x1*x4-x3*x2) + x2*(x1*y2-y1*x2))/det AS b,
    (n*(x2*y2-y1*x3) - x1*(x1*y2-y1*x2) + y0*(x1*x3-x2*x2))/det AS c FROM d)"""


@query(
    "polynomial_coefficients",
    QUADRATIC
    + f""" SELECT 'intercept' AS term, {r('a - 25 * b + 625 * c', 5)} AS coefficient FROM k UNION ALL
        SELECT 'q', {r('b - 50 * c', 5)} FROM k UNION ALL SELECT 'q^2', {r('c', 5)} FROM k""",
)
def polynomial(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_quantity AS q", "l_quantity * l_extendedprice / 1000 AS revenue")
    return tidy(regression.polynomial_regression(df, "q", "revenue", 2)[1], 5)


@query(
    "polynomial_fit",
    QUADRATIC
    + f""", e AS (SELECT avg(power(y - a - b * x - c * x * x, 2)) AS mse, var_pop(y) AS vy, count(*) AS n FROM z, k)
        SELECT {r('1 - mse / vy', 6)} AS r_squared, {r('sqrt(mse)', 4)} AS rmse, n AS n_samples FROM e""",
)
def polynomial_fit(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_quantity AS q", "l_quantity * l_extendedprice / 1000 AS revenue")
    f = regression.polynomial_regression(df, "q", "revenue", 2)[0]
    return f.select(
        (F.round("r_squared", 6) + F.lit(0.0)).alias("r_squared"), (F.round("rmse", 4) + F.lit(0.0)).alias("rmse"), "n_samples"
    )


# Newton steps on the penalised likelihood (C = 1, free intercept).
ORDER_CLASSES = """SELECT o_totalprice / 100000 AS x, (o_orderpriority IN ('1-URGENT', '2-HIGH') OR
    o_totalprice > 300000)::INT AS y FROM orders"""
NEWTON_STEPS = """fit(step, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
    SELECT step + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT step, b0, b1, sum(p - y) AS g0, sum((p - y) * x) + b1 AS g1, sum(p * (1 - p)) AS h00,
    sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1 AS h11
    FROM (SELECT step, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM fit, v) GROUP BY step, b0, b1) WHERE step < 15)"""


NEWTON = f"WITH RECURSIVE v AS ({ORDER_CLASSES}), {NEWTON_STEPS}"


@query(
    "logistic_regression_priority",
    NEWTON
    + f""" SELECT {r('any_value(b0)', 3)} AS intercept, {r('any_value(b1)', 3)} AS coefficient, {r('avg(((b0 + b1 * x >= 0)::INT = y)::INT)')} AS accuracy,
        {r('sum(y) FILTER (WHERE b0 + b1 * x >= 0) / count(*) FILTER (WHERE b0 + b1 * x >= 0)::DOUBLE')} AS precision,
        {r('sum(y) FILTER (WHERE b0 + b1 * x >= 0) / sum(y)::DOUBLE')} AS recall, count(*) AS n_samples FROM fit, v WHERE step = 15""",
)
def logistic(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_totalprice / 100000 AS x",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice > 300000 THEN 'yes' ELSE 'no' END AS chosen",
    )
    found = regression.logistic_regression(df, "x", "chosen", "yes")
    digits = {"intercept": 3, "coefficient": 3, "accuracy": 4, "precision": 4, "recall": 4}
    return found.select(*[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()], "n_samples")


@query(
    "logistic_regression_quality",
    "WITH RECURSIVE v AS (SELECT ln(n_chars) AS x, quality AS y FROM documents JOIN labels USING (doc_id)), "
    + NEWTON_STEPS
    + f""" SELECT {r('any_value(b0)', 2)} AS intercept, {r('any_value(b1)', 2)} AS coefficient,
        {r('avg(((b0 + b1 * x >= 0)::INT = y)::INT)')} AS accuracy, count(*) AS n_samples FROM fit, v WHERE step = 15""",
)
def logistic_quality(spark, folder):
    df = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").selectExpr("ln(n_chars) AS x", "quality")
    found = regression.logistic_regression(df, "x", "quality")
    digits = {"intercept": 2, "coefficient": 2, "accuracy": 4}
    return found.select(*[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()], "n_samples")


@query(
    "logistic_auc_urgent",
    f"""WITH v AS (SELECT (o_orderpriority = '1-URGENT')::INT AS y, o_totalprice AS x FROM orders),
        k AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM v),
        a AS (SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc,
        avg(y) AS base, count(*) AS n FROM k), c AS (SELECT covar_pop(y, x) AS c FROM v)
        SELECT {r('CASE WHEN c > 0 THEN auc ELSE 1 - auc END', 6)} AS roc_auc, {r('base', 6)} AS baseline_positive_rate, n AS n_samples FROM a, c""",
)
def logistic_auc(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_totalprice", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END AS urgent"
    )
    found = regression.logistic_regression(df, "o_totalprice", "urgent", "yes", rows_per_task=5000)
    return tidy(found.select("roc_auc", "baseline_positive_rate", "n_samples"), 6)


@query(
    "anova_price_by_priority",
    f"""WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1
        HAVING count(*) >= 2), t AS (SELECT sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM g)
        SELECT {r('(sum(g.n * power(m - gm, 2)) / any_value(k - 1)) / (sum((g.n - 1) * v) / any_value(t.n - k))')} AS f_statistic,
        count(*)::INT AS n_groups FROM g, t""",
)
def anova(spark, folder):
    return tidy(tests.anova(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority").select("f_statistic", "n_groups"))


@query(
    "anova_all_groups",
    f"""WITH g AS (SELECT o_custkey AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1
        HAVING count(*) >= 2), t AS (SELECT sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM g)
        SELECT {r('(sum(g.n * power(m - gm, 2)) / any_value(k - 1)) / (sum((g.n - 1) * v) / any_value(t.n - k))')} AS f_statistic,
        count(*)::INT AS n_groups FROM g, t""",
)
def anova_many(spark, folder):
    return tidy(tests.anova(table(spark, folder, "orders"), "o_totalprice", "o_custkey").select("f_statistic", "n_groups"))


def _jb(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {r('n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)', 2)} AS jarque_bera,
        least(5000, n) AS n_samples, n AS n_total FROM (SELECT count(*) AS n, avg(power(x - m, 2)) AS m2, avg(power(x - m, 3)) AS m3,
        avg(power(x - m, 4)) AS m4 FROM (SELECT {c} AS x, avg({c}) OVER () AS m FROM lineitem))"""


@query("normality_lineitem", " UNION ALL ".join(_jb(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def normality(spark, folder):
    df = table(spark, folder, "lineitem")
    found = tests.normality(df, ["l_quantity", "l_extendedprice", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return tidy(found.select("column", "jarque_bera", "n_samples", "n_total"), 2)


@query(
    "prepare_series_orders",
    f"SELECT o_orderdate AS date, {r('avg(o_totalprice)', 6)} AS value FROM orders GROUP BY 1",
)
def prepare(spark, folder):
    return tidy(timeseries.prepare_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"), 6)


@query(
    "infer_period_daily_events",
    "SELECT count(DISTINCT ts::DATE) AS n_observations, 'D' AS frequency, 7 AS period FROM events",
)
def infer_daily(spark, folder):
    df = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "value")
    return timeseries.period_table(df, "day", "value")


@query(
    "infer_period_monthly_orders",
    "SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS n_observations, 'MS' AS frequency, 12 AS period FROM orders",
)
def infer_monthly(spark, folder):
    df = table(spark, folder, "orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_totalprice")
    return timeseries.period_table(df, "month", "o_totalprice")


def _decomposition(period: int, additive: bool, group: str = "0") -> str:
    half = period // 2
    rows = "avg(y) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
    if period % 2:
        average = rows.format(half, half)
    else:
        average = f"({rows.format(half, half - 1)} + {rows.format(half - 1, half)}) / 2"
    minus, back = ("-", "+") if additive else ("/", "*")
    shown = "" if group == "0" else f"f.g AS {group}, "
    return f"""WITH s AS (SELECT {group} AS g, o_orderdate AS d, avg(ln(o_totalprice)) AS y FROM orders GROUP BY 1, 2),
        p AS (SELECT g, d, y, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM s),
        a AS (SELECT *, CASE WHEN i >= {half} AND i <= n - 1 - {half} THEN {average} END AS t FROM p),
        h AS (SELECT g, regr_slope(t, i) AS k, regr_intercept(t, i) AS b FROM a WHERE i >= {half} AND i < {half + period} GROUP BY g),
        e AS (SELECT g, regr_slope(t, i) AS k, regr_intercept(t, i) AS b FROM a
        WHERE i >= n - 1 - {half} - {period} AND i < n - 1 - {half} GROUP BY g),
        f AS (SELECT a.g, d, y, i, CASE WHEN i < {half} THEN i * h.k + h.b WHEN i > n - 1 - {half} THEN i * e.k + e.b ELSE t END AS t
        FROM a JOIN h ON a.g = h.g JOIN e ON a.g = e.g),
        q AS (SELECT g, i % {period} AS ph, avg(y {minus} t) AS raw FROM f GROUP BY 1, 2),
        z AS (SELECT g, ph, raw {minus} avg(raw) OVER (PARTITION BY g) AS s FROM q)
        SELECT {shown}d AS date, {r('y', 6)} AS value, {r('t', 6)} AS trend, {r('s', 6)} AS seasonal,
        {r(f'y {minus} (t {back} s)', 6)} AS residual FROM f JOIN z ON f.g = z.g AND f.i % {period} = z.ph"""


def price_series(spark, folder):
    return table(spark, folder, "orders").selectExpr("o_orderdate", "ln(o_totalprice) AS price")


@query("decompose_additive_weekly", _decomposition(7, True))
def decompose_additive(spark, folder):
    found = timeseries.decompose(price_series(spark, folder), "o_orderdate", "price", period=7)
    return tidy(found.drop("period"), 6)


@query("decompose_spread_over_tasks", _decomposition(12, True))
def decompose_pieces(spark, folder):
    found = timeseries.decompose(price_series(spark, folder), "o_orderdate", "price", period=12, rows_per_task=500)
    return tidy(found.drop("period"), 6)


@query("decompose_multiplicative", _decomposition(30, False))
def decompose_multiplicative(spark, folder):
    found = timeseries.decompose(price_series(spark, folder), "o_orderdate", "price", period=30, model="multiplicative")
    return tidy(found.drop("period"), 6)


@query("decompose_per_status", _decomposition(12, True, "o_orderstatus"))
def decompose_groups(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderstatus", "o_orderdate", "ln(o_totalprice) AS price")
    found = timeseries.decompose(df, "o_orderdate", "price", period=12, group_cols=["o_orderstatus"])
    return tidy(found.drop("period"), 6)


@query("forecast_arima_per_event_type")
def forecast(spark, folder):
    df = table(spark, folder, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return timeseries.forecast_arima(df, "day", "value", 6, group_cols=["event_type"])


# First-order autoregression in closed form: of the steps of a series, and around its mean.
AR_SERIES = """WITH s AS (SELECT event_type AS g, ts::DATE AS day, avg(value) AS y FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT g, day, y, {w} AS w FROM s WINDOW k AS (PARTITION BY g ORDER BY day)),
    v AS (SELECT *, lag(w) OVER (PARTITION BY g ORDER BY day) AS u FROM w),
    f AS (SELECT g, count(*) AS n, count(u) FILTER (WHERE w IS NOT NULL) AS m, {phi} AS phi, {mu} AS mu, max(day) AS ended, arg_max(y, day) AS y, arg_max(w, day) AS w FROM v GROUP BY 1),
    e AS (SELECT g, sum(power(v.w - mu - phi * (u - mu), 2)) / any_value(m) AS var FROM v JOIN f USING (g) WHERE u IS NOT NULL AND v.w IS NOT NULL GROUP BY 1),
    c AS (SELECT f.*, var, k, 2 * {size} + m * (ln(2 * pi() * var) + 1) AS aic, {size} * ln(m) + m * (ln(2 * pi() * var) + 1) AS bic FROM f JOIN e USING (g), range(1, 7) t(k)),
    z AS (SELECT *, {level} AS level, 1.959963984540054 * sqrt(var * list_sum(list_transform(range(0, k), lambda j: power({psi}, 2)))) AS reach FROM c)
    SELECT g AS event_type, (ended + k::INT) AS date, k::INT AS step, {forecast} AS forecast, {low} AS lower_ci, {high} AS upper_ci, {aic} AS aic, {bic} AS bic, n AS n_observations FROM z"""


def _autoregression(**parts: str) -> str:
    out = {n: r(x, 3) for n, x in {"forecast": "level", "low": "level - reach", "high": "level + reach", "aic": "aic", "bic": "bic"}.items()}
    return AR_SERIES.format(**parts, **out)


def _forecast(spark, folder, d):
    df = table(spark, folder, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    found = timeseries.forecast_arima(df, "day", "value", 6, 1, d, 0, group_cols=["event_type"])
    return tidy(found.withColumn("date", F.col("date").cast("date")), 3)


@query(
    "forecast_ar1_steps",
    _autoregression(
        w="y - lag(y) OVER k", phi="sum(w * u) / sum(u * u) FILTER (WHERE w IS NOT NULL)", mu="0.0", size="2",
        level="y + w * list_sum(list_transform(range(1, k + 1), lambda j: power(phi, j)))", psi="(1 - power(phi, j + 1)) / (1 - phi)",
    ),
)
def forecast_steps(spark, folder):
    return _forecast(spark, folder, 1)


@query(
    "forecast_ar1_mean",
    _autoregression(
        w="y", phi="regr_slope(w, u)", mu="regr_intercept(w, u) / (1 - regr_slope(w, u))", size="3",
        level="mu + (y - mu) * power(phi, k)", psi="power(phi, j)",
    ),
)
def forecast_mean(spark, folder):
    return _forecast(spark, folder, 0)


COHORTS = {
    "D": ("day", "strftime(f, '%Y-%m-%d')", "date_diff('day', f, p)"),
    "W": ("week", "strftime(f, '%Y-%m-%d') || '/' || strftime(f + INTERVAL 6 DAY, '%Y-%m-%d')", "date_diff('day', f, p) // 7"),
    "M": ("month", "strftime(f, '%Y-%m')", "date_diff('month', f, p)"),
    "Q": ("quarter", "year(f)::VARCHAR || 'Q' || quarter(f)::VARCHAR", "date_diff('month', f, p) // 3"),
}


def _cohort(freq: str, entity: str, date: str, t: str) -> str:
    unit, label, index = COHORTS[freq]
    return f"""WITH a AS (SELECT DISTINCT {entity} AS e, date_trunc('{unit}', {date})::DATE AS p FROM {t}),
        c AS (SELECT e, p, min(p) OVER (PARTITION BY e) AS f FROM a),
        g AS (SELECT f, p, count(*) AS u FROM c GROUP BY 1, 2), z AS (SELECT f, u AS s FROM g WHERE f = p)
        SELECT {label.replace('f', 'g.f').replace('strg.ftime', 'strftime')} AS cohort, ({index.replace('f, p', 'g.f, p')})::INT AS period_index, s AS cohort_size, u AS active_users,
        {r('u / s::DOUBLE * 100')} AS retention_rate FROM g JOIN z ON g.f = z.f"""


@query("cohort_daily_events", _cohort("D", "user_id", "ts", "events"))
def cohort_daily(spark, folder):
    return tidy(cohorts.cohort(table(spark, folder, "events"), "user_id", "ts", "D"))


@query("cohort_many_periods", _cohort("D", "o_custkey", "o_orderdate", "orders"))
def cohort_many(spark, folder):
    return tidy(cohorts.cohort(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "D"))


LAST_DAY = 30


@query(
    "cohort_matrix_daily",
    f"""WITH c AS ({_cohort("D", "user_id", "ts", "events")})
        SELECT cohort, cohort_size, {', '.join(f'max(active_users) FILTER (WHERE period_index = {i}) AS period_{i}' for i in range(LAST_DAY))}
        FROM c GROUP BY 1, 2""",
)
def cohort_matrix_daily(spark, folder):
    found = cohorts.cohort_matrix(table(spark, folder, "events"), "user_id", "ts", "D", "active_users", max_periods=1000)
    for i in range(LAST_DAY):  # a small table may lack some of the periods
        if f"period_{i}" not in found.columns:
            found = found.withColumn(f"period_{i}", F.lit(None).cast("long"))
    return found.select("cohort", "cohort_size", *[f"period_{i}" for i in range(LAST_DAY)])


@query("cohort_weekly_events", _cohort("W", "user_id", "ts", "events"))
def cohort_weekly(spark, folder):
    return tidy(cohorts.cohort(table(spark, folder, "events"), "user_id", "ts", "W"))


@query("cohort_monthly_orders", _cohort("M", "o_custkey", "o_orderdate", "orders"))
def cohort_monthly(spark, folder):
    return tidy(cohorts.cohort(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "M"))


@query("cohort_quarterly_orders", _cohort("Q", "o_custkey", "o_orderdate", "orders"))
def cohort_quarterly(spark, folder):
    return tidy(cohorts.cohort(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "Q"))


AB = """(SELECT count(*) FILTER (WHERE a = 'even') AS n1, count(*) FILTER (WHERE a = 'even' AND k) AS c1,
    count(*) FILTER (WHERE a = 'odd') AS n2, count(*) FILTER (WHERE a = 'odd' AND k) AS c2 FROM
    (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS a, event_type = 'purchase' AS k FROM events))"""


@query(
    "ab_test_purchases",
    f"""SELECT c1 AS control_conversions, n1 AS control_total, c2 AS variant_conversions, n2 AS variant_total,
        {r('c1 / n1::DOUBLE', 6)} AS control_rate, {r('c2 / n2::DOUBLE', 6)} AS variant_rate,
        {r('c2 / n2::DOUBLE - c1 / n1::DOUBLE', 6)} AS lift_absolute,
        {r('(c2 / n2::DOUBLE - c1 / n1::DOUBLE) / (c1 / n1::DOUBLE) * 100', 6)} AS lift_relative_percent,
        {r('(c2 / n2::DOUBLE - c1 / n1::DOUBLE) / sqrt((c1 + c2) / (n1 + n2)::DOUBLE * (1 - (c1 + c2) / (n1 + n2)::DOUBLE) * (1.0 / n1 + 1.0 / n2))', 6)}
        AS z_statistic FROM {AB}""",
)
def ab_test(spark, folder):
    df = table(spark, folder, "events").select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("arm"), (F.col("event_type") == "purchase").alias("bought")
    )
    found = tests.ab_test(df, "arm", "bought", "even", "odd")
    return tidy(
        found.select(
            "control_conversions", "control_total", "variant_conversions", "variant_total", "control_rate",
            "variant_rate", "lift_absolute", "lift_relative_percent", "z_statistic",
        ),
        6,
    )


@query("pearson_test", f"SELECT {r('corr(l_quantity, l_discount)', 6)} AS coefficient, count(*) AS n FROM {GAPPY_SQL} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def pearson(spark, folder):
    return tidy(tests.correlation_test(gappy(spark, folder), "l_quantity", "l_discount").select("coefficient", "n"), 6)


MIXED = "(SELECT l_quantity AS x, round(l_quantity / 10) * l_linenumber + l_tax AS y FROM lineitem)"


def mixed(spark, folder):
    return table(spark, folder, "lineitem").selectExpr("l_quantity AS x", "round(l_quantity / 10) * l_linenumber + l_tax AS y")


@query(
    "spearman_test",
    f"""WITH k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM {MIXED})
        SELECT {r('corr(rx, ry)', 6)} AS coefficient, count(*) AS n FROM k""",
)
def spearman(spark, folder):
    found = tests.correlation_test(mixed(spark, folder), "x", "y", "spearman")
    return tidy(found.select("coefficient", "n"), 6)


@query(
    "kendall_test",
    f"""WITH g AS (SELECT x, y, count(*)::DOUBLE AS c FROM {MIXED} GROUP BY 1, 2),
        d AS (SELECT sum(a.c * b.c) AS dis FROM g a JOIN g b ON a.x < b.x AND a.y > b.y),
        t AS (SELECT (SELECT sum(c) FROM g) AS n, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(c) AS k FROM g GROUP BY x)) AS tx,
        (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(c) AS k FROM g GROUP BY y)) AS ty, (SELECT sum(c * (c - 1) / 2) FROM g) AS txy)
        SELECT {r('(n * (n - 1) / 2 - tx - ty + txy - 2 * dis) / sqrt(n * (n - 1) / 2 - tx) / sqrt(n * (n - 1) / 2 - ty)', 6)}
        AS coefficient, n::BIGINT AS n FROM d, t""",
)
def kendall(spark, folder):
    found = tests.correlation_test(mixed(spark, folder), "x", "y", "kendall")
    return tidy(found.select("coefficient", "n"), 6)


@query(
    "overview_all_columns",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {r(f'corr({a}, {b})', 6)} AS correlation, count(*) AS n FROM lineitem"
        for i, a in enumerate(LINEITEM_NUMBERS)
        for b in LINEITEM_NUMBERS[i + 1 :]
    ),
)
def overview(spark, folder):
    df = table(spark, folder, "lineitem")
    _, found = tests.overview(df, ["l_orderkey", "l_linenumber", "l_partkey"])
    return tidy(found.select("column1", "column2", "correlation", "n"), 6)


@query("overview_normality", " UNION ALL ".join(_jb(c) for c in LINEITEM_NUMBERS))
def overview_normality(spark, folder):
    found = tests.overview(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"])[0]
    return tidy(found.select("column", "jarque_bera", "n_samples", "n_total"), 2)


ORACLES["mann_whitney_spread_over_tasks"] = ORACLES["mann_whitney_u"]
ORACLES["spearman_spread_over_tasks"] = ORACLES["spearman_test"]
ORACLES["kendall_spread_over_tasks"] = ORACLES["kendall_test"]


@query("mann_whitney_spread_over_tasks")
def mann_whitney_pieces(spark, folder):
    found = tests.mann_whitney_u(two(spark, folder), "a", "b", rows_per_task=20_000)
    return tidy(found.select("u_statistic", "median1", "median2", "n1", "n2"), 1)


@query("spearman_spread_over_tasks")
def spearman_pieces(spark, folder):
    found = tests.correlation_test(mixed(spark, folder), "x", "y", "spearman", rows_per_task=20_000)
    return tidy(found.select("coefficient", "n"), 6)


@query("kendall_spread_over_tasks")
def kendall_pieces(spark, folder):
    found = tests.correlation_test(mixed(spark, folder), "x", "y", "kendall", rows_per_task=5_000)
    return tidy(found.select("coefficient", "n"), 6)
