import functools
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon import AnalysisError
from tabulon.functions import special
from tabulon.operators import cohort, hypothesis_tests as tests, regression, timeseries
from tabulon.plans import arma


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(1.0, 2.5), (3.0, 4.1), (5.5, 6.0), (7.7, 9.0)], "a double, b double")


def test_distributions_against_the_bundled_math_library(spark):
    library = spark._jvm.org.apache.commons.math3.distribution
    for dof in (1.5, 7.0, 300.5):
        for t in (0.1, 1.7, 5.0):
            expected = 2 * (1 - library.TDistribution(dof).cumulativeProbability(t))
            assert math.isclose(special.t_two_sided(t, dof), expected, abs_tol=1e-10)
    for a, b, f in ((2.0, 9.0, 1.2), (49.0, 5000.0, 1.3), (5.0, 3.0, 0.2)):
        expected = 1 - library.FDistribution(a, b).cumulativeProbability(f)
        assert math.isclose(special.f_upper(f, a, b), expected, abs_tol=1e-10)
    for k, x in ((1.0, 0.5), (5.0, 20.0), (150.0, 100.0)):
        expected = 1 - library.ChiSquaredDistribution(k).cumulativeProbability(x)
        assert math.isclose(special.chi2_upper(x, k), expected, abs_tol=1e-10)


def test_shapiro_published_example():
    w, p = special.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert math.isclose(w, 0.78881, abs_tol=1e-5) and math.isclose(p, 0.006704, abs_tol=1e-6)
    assert special.shapiro_wilk([2.0, 2.0, 2.0, 2.0]) == (1.0, 1.0)


def test_exact_rank_distributions():
    assert np.diff([special.rank_sum_upto(u, 2, 3) for u in range(-1, 7)]).tolist() == [1, 1, 2, 2, 2, 1, 1]
    for m, n in ((1, 1), (1, 9), (3, 2), (4, 6), (5, 5), (8, 3)):  # all orderings one by one
        us = [sum(x - k for k, x in enumerate(c)) for c in itertools.combinations(range(m + n), m)]
        for u in range(m * n + 2):
            assert math.isclose(special.rank_sum_upper(u, m, n), np.mean(np.array(us) >= u))
    # Eight values against a billion: the limit is that of a sum of eight uniform numbers.
    assert math.isclose(special.rank_sum_upper(4 * 10**9, 8, 10**9), 0.5, rel_tol=1e-6)
    assert math.isclose(special.rank_sum_upper(7 * 10**9, 8, 10**9), 1 / math.factorial(8), rel_tol=1e-6)
    assert math.isclose(special.inversions_two_sided(0, 4), 2 / 24)
    assert math.isclose(special.inversions_two_sided(3, 6), 2 * (1 + 5 + 14 + 29) / 720)


def test_small_samples_use_exact_p(four):
    row = tests.mann_whitney_u(four, "a", "b").first()
    assert row["u_statistic"] == 6.0 and math.isclose(row["p_value"], 48 / 70) and row["method"] == "exact"
    row = tests.mann_whitney_u(four.unionByName(four), "a", "b").first()
    assert row["method"] == "normal"  # ties


def test_exact_p_of_a_tiny_and_a_large_sample(spark):
    values = spark.range(60_000).select(F.when(F.col("id") < 4, F.col("id") * 15_000 + 0.5).alias("a"), F.col("id").cast("double").alias("b"))
    row = tests.mann_whitney_u(values, "a", "b").first()
    assert row["method"] == "exact" and row["u_statistic"] == 4 + 15_000 * 6
    assert math.isclose(row["p_value"], 2 * special.rank_sum_upper(4 * 60_000 - row["u_statistic"], 4, 60_000))


def test_kendall_of_four(four):
    row = tests.correlation_test(four, "a", "b", "kendall").first()
    assert math.isclose(row["coefficient"], 1.0) and math.isclose(row["p_value"], 2 / 24)


def test_t_test_p(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0), (None, 10.0)], "a double, b double")
    row = tests.t_test(df, "a", "b").first()
    assert math.isclose(row["statistic"], (2.5 - 6) / math.sqrt((5 / 3) / 4 + 10 / 5))
    assert row["n1"] == 4 and row["n2"] == 5 and 0.0 < row["p_value"] < 0.1
    with pytest.raises(AnalysisError):
        tests.t_test(df.limit(1), "a", "b")


def test_constant_correlation_is_undefined(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "a long, b long")
    for method in ("pearson", "spearman", "kendall"):
        assert tests.correlation_test(df, "a", "b", method).first()["coefficient"] is None


def test_chi_square_of_many_categories(spark):
    df = spark.range(300).select(
        F.concat(F.lit("a"), F.col("id") % 60).alias("x"), F.concat(F.lit("b"), F.col("id") % 60).alias("y")
    )
    row = tests.chi_square(df, "x", "y").first()  # each category of one goes with one of the other
    assert math.isclose(row["chi2_statistic"], 300 * 59) and row["degrees_of_freedom"] == 59 * 59
    assert (row["categories1"], row["categories2"], row["n"]) == (60, 60, 300)


def test_chi_square_counts_pairs_that_do_not_occur(spark):
    rows = [("a", "x")] * 30 + [("b", "y")] * 20 + [("b", "x")] * 5 + [("c", "z")] * 7
    row = tests.chi_square(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    table = np.array([[30, 0, 0], [5, 20, 0], [0, 0, 7]])
    expected = table.sum(axis=1)[:, None] * table.sum(axis=0) / table.sum()
    assert math.isclose(row["chi2_statistic"], ((table - expected) ** 2 / expected).sum())
    two = spark.createDataFrame([("a", "x")] * 12 + [("b", "y")] * 9, "p string, q string")  # two of four pairs
    expected = np.array([[12 * 12, 12 * 9], [9 * 12, 9 * 9]]) / 21
    gaps = np.abs(np.array([[12, 0], [0, 9]]) - expected) - 0.5
    assert math.isclose(tests.chi_square(two, "p", "q").first()["chi2_statistic"], (gaps**2 / expected).sum())


def test_two_by_two_is_corrected(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 15 + [("b", "y")] * 5
    row = tests.chi_square(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    expected = sum((abs(o - e) - 0.5) ** 2 / e for o, e in [(10, 15), (20, 15), (15, 10), (5, 10)])
    assert math.isclose(row["chi2_statistic"], expected) and row["degrees_of_freedom"] == 1


def test_ab_winner(spark):
    row = tests.ab_counts(spark, 120, 1000, 150, 1000).first()
    assert row["winner"] == "variant" and math.isclose(row["p_value"], 0.0496403868, abs_tol=1e-9)
    for bad in [(1, 0, 1, 1), (-1, 5, 1, 5), (6, 5, 1, 5), (0, 5, 0, 5), ("x", 1, 1, 1)]:
        with pytest.raises(AnalysisError):
            tests.ab_counts(spark, *bad)


def test_normality(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": range(7000), "n": rng.normal(size=7000), "e": rng.exponential(size=7000)})
    found = {r["column"]: r for r in tests.normality(spark.createDataFrame(pdf), ["n", "e"], ["k"]).collect()}
    assert found["n"]["n_samples"] == 5000 and found["n"]["n_total"] == 7000
    assert found["n"]["statistic"] > 0.99 and not found["e"]["is_normal"]


def test_regressions(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(10, 20, 300)
    y = 3 + 2 * x - 0.5 * x**2 + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    row = regression.linear_regression(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert math.isclose(row["slope"], slope, rel_tol=1e-9) and math.isclose(row["intercept"], intercept, rel_tol=1e-9)
    for degree in (2, 6):
        fit, table = regression.polynomial_regression(df, "x", "y", degree)
        predicted = np.polyval(np.polyfit(x - 15, y, degree), x - 15)
        assert math.isclose(fit.first()["rmse"], np.sqrt(((y - predicted) ** 2).mean()), rel_tol=1e-5)
        assert table.count() == degree + 1
    with pytest.raises(AnalysisError):
        regression.polynomial_regression(df, "x", "y", 7)


def test_logistic_matches_the_penalised_optimum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(2, 3, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.8 * x - 1)))).astype(int)
    b = np.zeros(2)
    design = np.column_stack([np.ones(400), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ b))
        gradient = design.T @ (p - y) + np.array([0, b[1]])
        b -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0, 1.0]), gradient)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.where(y == 1, "yes", "no")}))
    row = regression.logistic_regression(df, "x", "y").first()
    assert row["positive_class"] == "yes"
    assert math.isclose(row["intercept"], b[0], rel_tol=1e-4) and math.isclose(row["coefficient"], b[1], rel_tol=1e-4)
    better = np.mean([(x[y == 1] > v).mean() + (x[y == 1] == v).mean() / 2 for v in x[y == 0]])
    assert math.isclose(row["roc_auc"], better, rel_tol=1e-9)
    assert math.isclose(row["accuracy"], ((design @ b >= 0) == (y == 1)).mean(), abs_tol=0.006)


def test_cohort_of_many_periods(spark):
    dates = pd.date_range("2000-01-01", periods=500, freq="3D")
    df = spark.createDataFrame(pd.DataFrame({"e": ["u%d" % (i % 9) for i in range(500)], "d": dates}))
    found = cohort.cohort(df, "e", "d", "D").toPandas()
    # Entity k is first seen on day 3k and then every 27 days: a cohort each.
    assert len(found) == 500 and found.active_users.eq(1).all() and found.period_index.max() == 55 * 27
    found = cohort.cohort(df, "e", "d", "M").toPandas()
    assert (found[found.period_index == 0].retention_rate == 100).all()
    matrix = cohort.cohort_matrix(df, "e", "d", "Q").first()
    assert matrix["cohort"] == "2000Q1" and matrix["period_0"] == 100.0


def test_cohort_matrix_holds_every_cell_or_raises(spark):
    days = spark.range(40).crossJoin(spark.range(70).withColumnRenamed("id", "k"))
    events = days.select("id", F.expr("date_add(date'2020-01-01', cast(id + k as int))").alias("d"))  # 40 cohorts, 70 days each
    for limit in (30, 69):  # too few for the cohorts, and for the periods only
        with pytest.raises(AnalysisError, match="40 cohorts and 70 periods"):
            cohort.cohort_matrix(events, "id", "d", "D", max_periods=limit)
    found = cohort.cohort_matrix(events, "id", "d", "D", "active_users", max_periods=70).toPandas()
    assert found.shape == (40, 72) and found.drop(columns=["cohort", "cohort_size"]).eq(1).all().all()


@pytest.mark.parametrize(
    "freq,found,period", [("D", "D", 7), ("B", "B", 7), ("MS", "MS", 12), ("QS", "QS", 4), ("5h", None, 7)]
)
def test_frequencies(spark, freq, found, period):
    days = pd.date_range("2020-01-01", periods=45, freq=freq)
    series = spark.createDataFrame(pd.DataFrame({"date": days, "value": 1.0})).repartition(3)
    series = series.withColumn("date", F.col("date").cast("timestamp_ntz"))
    assert timeseries.frequency(series, rows_per_task=10) == found
    assert timeseries.infer_period(series) == period


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition_recomposes(spark, model):
    t = np.arange(48)
    season = np.tile([1.0, 2.0, 4.0, 3.0], 12)
    value = 50 + t + season if model == "additive" else (50 + t) * season
    pdf = pd.DataFrame({"d": pd.date_range("2015-01-01", periods=48, freq="QS"), "v": value})
    found = timeseries.decompose(spark.createDataFrame(pdf), "d", "v", model=model).orderBy("date").toPandas()
    parts = found.trend + found.seasonal + found.residual
    if model == "multiplicative":
        parts = found.trend * found.seasonal * found.residual
    assert np.allclose(parts, value) and set(found.period) == {4}
    if model == "additive":
        assert np.allclose(found.trend, 52.5 + t) and np.allclose(found.residual, 0, atol=1e-9)


def arma_series(n, ar, ma, seed=1):
    eps = np.random.default_rng(seed).normal(size=n)
    w = np.zeros(n)
    for i in range(n):
        w[i] = eps[i] + sum(a * w[i - k] for k, a in enumerate(ar, 1) if i >= k) + sum(m * eps[i - k] for k, m in enumerate(ma, 1) if i >= k)
    return w, eps


def arma_errors(w, mean, ar, ma):
    out = []
    for t in range(len(w)):
        e = w[t] - mean - sum(a * (w[t - i] - mean) for i, a in enumerate(ar, 1) if t >= i)
        out.append(e - sum(m * out[t - j] for j, m in enumerate(ma, 1) if t >= j))
    return np.array(out)


@pytest.mark.parametrize("p,q,mean", [(0, 0, True), (1, 0, False), (0, 1, False), (1, 1, True), (2, 1, True), (1, 3, False), (3, 2, True)])
def test_arma_products_are_those_of_the_recursion(p, q, mean):
    """Whatever pieces the series is cut into."""
    orders, rng = arma.Orders(p, q, mean), np.random.default_rng(p + 5 * q)
    w = rng.normal(size=700) + 2
    theta = rng.uniform(-0.3, 0.3, orders.size)

    def errors(t):
        return arma_errors(w, *orders.split(t))

    step = 1e-6
    slopes = [(errors(theta + step * np.eye(orders.size)[i]) - errors(theta - step * np.eye(orders.size)[i])) / (2 * step) for i in range(orders.size)]
    z = np.array([errors(theta), *slopes])[:, p:]
    for cuts in ([0, 700], [0, 1, 5, 300, 301, 557, 700]):
        parts = []
        for low, high in zip(cuts, cuts[1:]):
            context = min(low, p + 1)
            parts.append(arma.summarise(w[low - context : high], context, low, theta, orders))
        products, state = arma.settle_state(functools.reduce(arma.compose, parts))
        assert np.allclose(products, z @ z.T, rtol=1e-6, atol=1e-4)
        assert np.allclose(state[: max(q, 1)], errors(theta)[::-1][: max(q, 1)])


def test_arima_recovers_known_parameters():
    w, eps = arma_series(4000, [0.6], [0.3])
    fit = arma.fit(w, arma.Orders(1, 1, False))
    assert abs(fit.theta[0] - 0.6) < 0.05 and abs(fit.theta[1] - 0.3) < 0.05 and abs(fit.loss / 3999 - 1) < 0.06
    for move in ([1e-3, 0], [0, 1e-3], [-1e-3, 0], [0, -1e-3]):  # it is the least of the squares
        around = np.array(fit.theta) + move
        assert (arma_errors(w, 0.0, around[:1], around[1:])[1:] ** 2).sum() > fit.loss
    w, _ = arma_series(5000, [0.5, -0.3], [0.4, 0.2], 3)
    fit = arma.fit(w + 50, arma.Orders(2, 2, True))
    assert np.allclose(fit.theta, [50, 0.5, -0.3, 0.4, 0.2], atol=0.25) and fit.passes < 40
    walk = np.cumsum(eps)
    level, spread, _, _ = timeseries.predict(arma.fit(np.diff(walk), arma.Orders(0, 0, False)), walk[-5:], 1, len(walk), 4)
    assert np.allclose(level, walk[-1]) and np.allclose(spread / spread[0], np.sqrt([1, 2, 3, 4]))


@pytest.mark.parametrize("p,d,q", [(1, 1, 1), (2, 0, 0)])
def test_forecasts_do_not_depend_on_the_pieces(spark, p, d, q):
    w, _ = arma_series(400, [0.5], [0.3])
    frames = [
        pd.DataFrame({"g": g, "d": pd.date_range("2020-01-31", periods=n, freq=freq), "v": np.cumsum(w[:n]) + 9})
        for g, n, freq in (("long", 400, "D"), ("month", 333, "ME"), ("odd", 90, "h"), ("tiny", 5, "D"), (None, 150, "B"))
    ]
    frames[2].loc[40:, "d"] += pd.Timedelta("17min")  # one gap of its own: the median counts
    df = spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=2))

    def found(size):
        out = timeseries.forecast_arima(df, "d", "v", 5, p, d, q, group_cols=["g"], rows_per_piece=size)
        assert out.columns[0] == "g"
        return out.toPandas().sort_values(["g", "step"], na_position="first").reset_index(drop=True)

    whole, pieces = found(1 << 16), found(70)
    assert len(whole) == 4 * 5 + 1 and whole[whole.g == "tiny"].n_observations.tolist() == [5]
    pd.testing.assert_frame_equal(whole, pieces, rtol=1e-4)
    next_days = {g: rows.date.iloc[0] for g, rows in whole.groupby("g")}
    assert next_days["long"] == frames[0].d.iloc[-1] + pd.Timedelta("1D")
    assert next_days["month"] == frames[1].d.iloc[-1] + pd.offsets.MonthEnd(1)
    assert next_days["odd"] == frames[2].d.iloc[-1] + pd.Timedelta("1h")
    assert whole[whole.g.isna()].date.iloc[0] == frames[4].d.iloc[-1] + pd.offsets.BDay(1)


def test_forecast_frame(spark):
    days = pd.date_range("2024-01-01", periods=60, freq="MS")
    pdf = pd.concat([pd.DataFrame({"g": g, "d": days, "v": np.arange(60.0) * k}) for g, k in (("a", 1), ("b", 3))])
    found = timeseries.forecast_arima(spark.createDataFrame(pdf), "d", "v", 3, group_cols=["g"]).toPandas()
    assert len(found) == 6 and found.date.min() == pd.Timestamp("2029-01-01")
    assert (found.upper_ci >= found.forecast).all()
    alone = timeseries.forecast_arima(spark.createDataFrame(pdf[pdf.g == "b"]), "d", "v", 3).toPandas()
    assert np.allclose(alone.forecast, found[found.g == "b"].forecast)
    with pytest.raises(AnalysisError):
        timeseries.forecast_arima(spark.createDataFrame(pdf.head(5)), "d", "v", 3)


def test_normality_sample_grows_where_hashes_clump(spark, monkeypatch):
    """All rows of a key have one hash: the first share may hold none of them."""
    from tabulon.operators import hypothesis_tests

    seen = []
    plain = hypothesis_tests._shapiro
    monkeypatch.setattr(hypothesis_tests, "_shapiro", lambda *a: seen.append(dict(a[4])) or plain(*a))
    df = spark.range(4000).select(F.lit(1).alias("k"), F.randn(3).alias("x"), F.rand(4).alias("y")).persist()
    clumped = hypothesis_tests.normality(df, ["x", "y"], ["k"], sample=50).collect()
    assert [r["n_samples"] for r in clumped] == [50, 50]
    assert [set(s) for s in seen] == [{0, 1}] * len(seen) and len(seen) > 1
    spread = hypothesis_tests.normality(df.withColumn("k", F.col("x")), ["x"], ["k"], sample=50).first()
    place = F.xxhash64(F.lit(42), F.col("x"))
    values = [r["x"] for r in df.orderBy(place, "x").limit(50).collect()]
    assert spread["statistic"] == pytest.approx(hypothesis_tests.special.shapiro_wilk(np.array(values))[0], rel=1e-12)
    with pytest.raises(AnalysisError):
        hypothesis_tests.normality(df, ["x"], sample=6000)
