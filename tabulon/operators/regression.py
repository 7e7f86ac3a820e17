"""Linear, polynomial and logistic regression on one predictor."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tabulon.errors import AnalysisError
from tabulon.functions import special
from tabulon.functions.columns import as_double, as_text, is_missing, require, require_numeric
from tabulon.plans.correlations import pair_statistics, pearson
from tabulon.plans.ordered import ROWS_PER_TASK
from tabulon.plans.ranks import two_sample_ranks
from tabulon.plans.results import result_frame

ALPHA = 0.05


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    require_numeric(df, x, y)
    return df.select(as_double(df, x).alias("x"), as_double(df, y).alias("y")).na.drop()


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of ``y`` on ``x`` from one pass of centred sums."""
    pairs = _complete(df, x, y)
    statistics = pair_statistics(pairs, ["x", "y"])["x", "y"]
    n, covariance, sx, sy = statistics
    if n < 3:
        raise AnalysisError("Insufficient data for regression")
    means = pairs.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    slope = covariance / (sx * sx) if sx else 0.0
    intercept = means["y"] - slope * means["x"]
    r = pearson(statistics)
    explained = slope * covariance
    residual = max(0.0, sy * sy - explained)
    r2 = 1 - residual / (sy * sy) if sy else 1.0
    p = special.correlation_p(r, n) if r is not None else None
    return result_frame(
        df.sparkSession,
        [
            (
                x, y, slope, intercept, r2, math.sqrt(residual), r, p, p is not None and p < ALPHA, n,
                f"y = {slope:.4f}x + {intercept:.4f}",
            )
        ],
        "x_column string, y_column string, slope double, intercept double, r_squared double, rmse double, "
        "correlation double, p_value double, significant boolean, n_samples long, equation string",
    )


def polynomial_regression(df: DataFrame, x: str, y: str, degree: int = 2) -> tuple[DataFrame, DataFrame]:
    """(fit, coefficients) of a polynomial of degree 2 to 6.

    Power sums of the standardised predictor come from one aggregate; the small
    normal equations are solved and expanded back. A second pass measures the
    residuals themselves.
    """
    if not 2 <= degree <= 6:
        raise AnalysisError("degree must be between 2 and 6")
    pairs = _complete(df, x, y)
    base = pairs.agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.avg("y").alias("y"),
        F.var_pop("y").alias("vy"),
    ).first()
    n = base["n"]
    if n < max(10, degree + 2):
        raise AnalysisError("Insufficient data for polynomial regression")
    mean, std = base["mean"], base["std"] or 1.0
    z = (F.col("x") - F.lit(mean)) / F.lit(std)
    gap = F.col("y") - F.lit(base["y"])

    def power(k: int):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * z
        return out

    sums = pairs.agg(
        *[F.avg(power(k)).alias(f"p{k}") for k in range(2 * degree + 1)],
        *[F.avg(power(k) * gap).alias(f"t{k}") for k in range(degree + 1)],
    ).first()
    gram = np.array([[sums[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    target = np.array([sums[f"t{i}"] for i in range(degree + 1)])
    scaled = np.linalg.lstsq(gram, target, rcond=None)[0]
    fitted = F.lit(0.0)
    for c in reversed(scaled):
        fitted = fitted * z + F.lit(float(c))
    residual = pairs.agg(F.avg((gap - fitted) * (gap - fitted)).alias("r")).first()["r"]
    shifted = np.polynomial.Polynomial(scaled)(np.polynomial.Polynomial([-mean / std, 1 / std]))
    coefficients = np.zeros(degree + 1)
    coefficients[: len(shifted.coef)] = shifted.coef
    coefficients[0] += base["y"]
    r2 = 1 - residual / base["vy"] if base["vy"] else 1.0
    fit = result_frame(
        df.sparkSession,
        [(x, y, degree, r2, math.sqrt(residual), n)],
        "x_column string, y_column string, degree int, r_squared double, rmse double, n_samples long",
    )
    terms = ["intercept", x] + [f"{x}^{k}" for k in range(2, degree + 1)]
    table = result_frame(
        df.sparkSession, list(zip(terms, map(float, coefficients))), "term string, coefficient double"
    )
    return fit, table


def logistic_regression(
    df: DataFrame, x: str, y: str, positive_class: str | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """L2-penalised (C = 1, free intercept) logistic fit with classification measures.

    Rows are first reduced to counts per (predictor, class), which the model takes
    as weights. AUC follows from tie-aware ranks of the predictor.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    require(df, x, y)
    require_numeric(df, x)
    rows = df.filter(~is_missing(df, x) & ~is_missing(df, y)).select(
        as_double(df, x).alias("x"), as_text(df, y).alias("c")
    )
    classes = sorted(r["c"] for r in rows.select("c").distinct().limit(3).collect())
    n = rows.count()
    if n < 10:
        raise AnalysisError("Insufficient data for logistic regression")
    if len(classes) != 2:
        raise AnalysisError("Target column must have exactly 2 classes for logistic regression")
    if positive_class is not None and positive_class not in classes:
        raise AnalysisError("positive_class does not match target classes")
    positive = classes[-1] if positive_class is None else positive_class

    binary = rows.select("x", (F.col("c") == F.lit(positive)).cast("double").alias("label"))
    weighted = binary.groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("w"))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(weighted)
    model = LogisticRegression(
        weightCol="w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10
    ).fit(vectors)
    coefficient, intercept = float(model.coefficients[0]), float(model.intercept)

    score = F.col("x") * F.lit(coefficient) + F.lit(intercept)
    hit, true = score >= 0, F.col("label") == 1
    m = binary.agg(
        F.count_if(true).alias("positives"),
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(hit == true).alias("right"),
    ).first()
    positives = m["positives"]
    ranked = binary.select((F.lit(1) - F.col("label")).cast("int").alias("sample"), F.col("x").alias("value"))
    rank_sum = two_sample_ranks(ranked, n, rows_per_task)["rank_sum"]
    auc = (rank_sum - positives * (positives + 1) / 2) / (positives * (n - positives))
    auc = 0.5 if coefficient == 0 else auc if coefficient > 0 else 1 - auc
    precision = m["tp"] / (m["tp"] + m["fp"]) if m["tp"] + m["fp"] else 0.0
    recall = m["tp"] / positives
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return result_frame(
        df.sparkSession,
        [
            (
                x, y, positive, classes, n, intercept, coefficient, _exp(intercept), _exp(coefficient),
                m["right"] / n, precision, recall, f1, auc, positives / n,
            )
        ],
        "x_column string, y_column string, positive_class string, classes array<string>, n_samples long, "
        "intercept double, coefficient double, intercept_odds_ratio double, odds_ratio double, accuracy double, "
        "precision double, recall double, f1_score double, roc_auc double, baseline_positive_rate double",
    )


def _exp(value: float) -> float:
    return math.exp(value) if value < 700 else math.inf
