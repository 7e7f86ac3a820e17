"""Hypothesis tests. Spark reduces the table to sufficient statistics; a closed
form turns those few numbers into a p-value. Every result is a one-row frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.errors import AnalysisError
from tabulon.functions import special
from tabulon.functions.columns import as_double, as_text, col, is_missing, numeric_columns, require, require_numeric
from tabulon.plans.correlations import pair_statistics, pearson
from tabulon.plans.ordered import ROWS_PER_TASK
from tabulon.plans.quantiles import exact_quantiles
from tabulon.plans.ranks import discordant_pairs, spearman_r, tie_sums, two_sample_ranks
from tabulon.plans.results import result_frame

ALPHA = 0.05
NAMED_GROUPS = 20
EXACT_SIZE = 8
SHAPIRO_LIMIT = 5000


def _finite(value: float | None) -> float | None:
    return None if value is None or math.isnan(value) or math.isinf(value) else float(value)


def t_test(df: DataFrame, first: str, second: str, equal_var: bool = False) -> DataFrame:
    """Independent t-test of two columns, Welch's unless ``equal_var``."""
    require_numeric(df, first, second)
    aggs = []
    for tag, name in (("1", first), ("2", second)):
        v = as_double(df, name)
        aggs += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"m{tag}"), F.var_samp(v).alias(f"v{tag}")]
    r = df.agg(*aggs).first()
    n1, n2 = r["n1"], r["n2"]
    if n1 < 2 or n2 < 2:
        raise AnalysisError("Insufficient data for t-test")
    if equal_var:
        dof = n1 + n2 - 2
        pooled = ((n1 - 1) * r["v1"] + (n2 - 1) * r["v2"]) / dof
        error = math.sqrt(pooled * (1 / n1 + 1 / n2))
    else:
        a, b = r["v1"] / n1, r["v2"] / n2
        error = math.sqrt(a + b)
        dof = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if error else math.nan
    difference = r["m1"] - r["m2"]
    t = difference / error if error else None
    p = special.t_two_sided(t, dof) if t is not None else None
    return result_frame(
        df.sparkSession,
        [
            (
                first, second, t, p, p is not None and p < ALPHA, equal_var, _finite(dof), r["m1"], r["m2"],
                math.sqrt(r["v1"]), math.sqrt(r["v2"]), n1, n2,
            )
        ],
        "column1 string, column2 string, statistic double, p_value double, significant boolean, "
        "equal_variance_assumed boolean, degrees_of_freedom double, mean1 double, mean2 double, "
        "std1 double, std2 double, n1 long, n2 long",
    )


def mann_whitney_u(
    df: DataFrame, first: str, second: str, alternative: str = "two-sided", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """U of the first column, and p with the method it was found by: exact where the smaller
    sample has at most 8 values and none are tied, however large the other is, else normal."""
    if alternative not in ("two-sided", "less", "greater"):
        raise AnalysisError("alternative must be two-sided, less or greater")
    require_numeric(df, first, second)
    x, y = as_double(df, first), as_double(df, second)
    sizes = df.agg(F.count(x).alias("n1"), F.count(y).alias("n2")).first()
    n1, n2 = sizes["n1"], sizes["n2"]
    if n1 < 2 or n2 < 2:
        raise AnalysisError("Insufficient data for Mann-Whitney test")
    sides = F.array(
        F.struct(F.lit(0).alias("sample"), x.alias("value")), F.struct(F.lit(1).alias("sample"), y.alias("value"))
    )
    rows = df.select(F.inline(sides)).filter(F.col("value").isNotNull())
    found = two_sample_ranks(rows, n1 + n2, rows_per_task)
    u1 = found["rank_sum"] - n1 * (n1 + 1) / 2
    u2 = float(n1) * n2 - u1
    u = {"two-sided": max(u1, u2), "greater": u1, "less": u2}[alternative]
    exact = min(n1, n2) <= EXACT_SIZE and found["largest_tie"] == 1
    if exact:
        p = special.rank_sum_upper(u, n1, n2)
    else:
        n = n1 + n2
        variance = n1 * n2 / 12 * ((n + 1) - found["tie_term"] / (n * (n - 1)))
        p = special.normal_upper((u - n1 * n2 / 2 - 0.5) / math.sqrt(variance)) if variance > 0 else None
    if p is not None:
        p = min(1.0, p * 2 if alternative == "two-sided" else p)
    slim = df.select(x.alias("a"), y.alias("b"))
    medians = exact_quantiles(slim, ["a", "b"], [0.5])
    return result_frame(
        df.sparkSession,
        [(first, second, alternative, u1, p, p is not None and p < ALPHA, medians["a"][0.5], medians["b"][0.5], n1, n2, "exact" if exact else "normal")],
        "column1 string, column2 string, alternative string, u_statistic double, p_value double, "
        "significant boolean, median1 double, median2 double, n1 long, n2 long, method string",
    )


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """Observed and expected counts of every pair of categories, zeros included."""
    observed = _counted_pairs(df, first, second)
    rows = observed.groupBy("a").agg(F.sum("o").alias("row_total"))
    cols = observed.groupBy("b").agg(F.sum("o").alias("col_total"))
    total = observed.agg(F.sum("o").alias("total"))  # one row
    grid = rows.crossJoin(F.broadcast(total)).crossJoin(cols)  # the result has a row for each pair
    found = grid.join(observed, ["a", "b"], "left")
    return found.select(
        F.col("a").alias("category1"), F.col("b").alias("category2"), F.coalesce("o", F.lit(0)).cast("long").alias("observed"),
        (F.col("row_total") * F.col("col_total") / F.col("total")).alias("expected"),
    )


def _counted_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of the pairs that occur."""
    require(df, first, second)
    both = df.filter(~is_missing(df, first) & ~is_missing(df, second))
    return both.groupBy(as_text(df, first).alias("a"), as_text(df, second).alias("b")).agg(F.count(F.lit(1)).alias("o"))


def chi_square(df: DataFrame, first: str, second: str) -> DataFrame:
    """Independence of two categorical columns, with Yates' correction for one degree of freedom.

    Only pairs that occur are looked at, each beside its two margins: they add (o - e)^2 / e,
    and all that is expected elsewhere is n less what is expected of them.
    """
    observed = _counted_pairs(df, first, second)
    beside = observed.select(
        "a", "b", "o",
        F.sum("o").over(Window.partitionBy("a")).alias("row_total"), F.sum("o").over(Window.partitionBy("b")).alias("col_total"),
        (F.row_number().over(Window.partitionBy("a").orderBy("b")) == 1).alias("new_a"),
        (F.row_number().over(Window.partitionBy("b").orderBy("a")) == 1).alias("new_b"),
    )
    total = observed.agg(F.sum("o").alias("n"))  # one row
    beside = beside.crossJoin(F.broadcast(total))
    o, n = F.col("o"), F.col("n")
    e = F.col("row_total").cast("double") * F.col("col_total") / n
    # For two by two categories all four gaps are equal, also that of a pair that does not occur.
    gap = F.abs(o - e)
    r = beside.agg(
        F.max("n").alias("n"), F.sum((o - e) * (o - e) / e).alias("seen"), F.sum(e).alias("expected"),
        F.count_if("new_a").alias("k1"), F.count_if("new_b").alias("k2"),
        F.max(gap).alias("gap"), F.max(F.when(F.col("new_a"), F.col("row_total"))).alias("r"), F.max(F.when(F.col("new_b"), F.col("col_total"))).alias("c"),
    ).first()
    total, k1, k2 = r["n"], r["k1"], r["k2"]
    if k1 * k2 < 4:
        raise AnalysisError("Insufficient categories for chi-square test")
    dof = (k1 - 1) * (k2 - 1)
    statistic = max(0.0, r["seen"] + max(0.0, total - r["expected"])) if dof else 0.0
    if dof == 1:
        short = r["gap"] - min(0.5, r["gap"])
        margins = [(x, y) for x in (r["r"], total - r["r"]) for y in (r["c"], total - r["c"])]
        statistic = sum(short * short * total / (x * y) for x, y in margins)
    p = special.chi2_upper(statistic, dof) if dof else 1.0
    return result_frame(
        df.sparkSession,
        [(first, second, statistic, p, dof, p < ALPHA, k1, k2, total)],
        "column1 string, column2 string, chi2_statistic double, p_value double, degrees_of_freedom long, "
        "significant boolean, categories1 int, categories2 int, n long",
    )


def anova(df: DataFrame, numeric: str, group: str) -> DataFrame:
    """One-way ANOVA over all groups that hold at least two values; the first 20 are named."""
    require(df, numeric, group)
    require_numeric(df, numeric)
    v = as_double(df, numeric)
    groups = (
        df.filter(~is_missing(df, group) & v.isNotNull())
        .groupBy(col(group).alias("g"))
        .agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"))
        .filter("n >= 2")
        .persist()
    )
    try:
        r = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")).first()
        k, n = r["k"], r["n"]
        if k < 2:
            raise AnalysisError("Need at least 2 groups with 2 or more values each for ANOVA")
        away = F.col("m") - F.lit(r["mean"])
        sums = groups.agg(F.sum(F.col("n") * away * away).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within")).first()
        names = [str(g["g"]) for g in groups.orderBy("g").limit(NAMED_GROUPS).collect()]
    finally:
        groups.unpersist()
    between, within = sums["between"] / (k - 1), sums["within"] / (n - k)
    f = between / within if within else None
    p = special.f_upper(f, k - 1, n - k) if f is not None else None
    return result_frame(
        df.sparkSession,
        [(numeric, group, f, p, p is not None and p < ALPHA, k, names)],
        "numeric_column string, group_column string, f_statistic double, p_value double, significant boolean, "
        "n_groups int, group_names array<string>",
    )


def normality(
    df: DataFrame, columns: Sequence[str], key: Sequence[str] | None = None, seed: int = 42, sample: int = SHAPIRO_LIMIT
) -> DataFrame:
    """Shapiro-Wilk on at most ``sample`` values per column (the test is not defined beyond
    5000), and Jarque-Bera on all of them. The verdict rests on all values: on Jarque-Bera where
    Shapiro-Wilk has seen only a sample.

    The sample holds the rows with the smallest hash of ``key`` (repeatable), or
    random ones without a key.
    """
    require_numeric(df, *columns)
    if not 3 <= sample <= SHAPIRO_LIMIT:
        raise AnalysisError(f"sample must be from 3 to {SHAPIRO_LIMIT}")
    aggs = []
    for i, n in enumerate(columns):
        v = as_double(df, n)
        aggs += [F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"s{i}"), F.kurtosis(v).alias(f"k{i}")]
    whole = df.agg(*aggs).first()
    sizes = [whole[f"n{i}"] for i in range(len(columns))]
    found: dict[int, tuple] = {}
    shares = {i: min(1.0, 4 * sample / max(n, 1)) for i, n in enumerate(sizes)}
    while shares:  # once, unless hashes clump: then a larger share of those columns alone
        found |= _shapiro(df, columns, key, seed, shares, sample)
        short = [i for i in shares if found.get(i, (None, None, 0))[2] < min(sizes[i], sample) and shares[i] < 1]
        shares = {i: min(1.0, 8 * shares[i]) for i in short}
    out = []
    for i, n in enumerate(columns):
        w, p, taken = found.get(i, (None, None, 0))
        if taken < 3:
            continue
        s, k = whole[f"s{i}"], whole[f"k{i}"]
        jb = sizes[i] / 6 * (s * s + k * k / 4) if s is not None and k is not None else None
        jb_p = special.chi2_upper(jb, 2) if jb is not None else None
        verdict = p if taken == sizes[i] or jb_p is None else jb_p
        out.append((n, w, p, verdict > ALPHA, taken, jb, jb_p, sizes[i]))
    if not out and len(columns) == 1:
        raise AnalysisError("Insufficient data")
    return result_frame(
        df.sparkSession,
        out,
        "column string, statistic double, p_value double, is_normal boolean, n_samples long, "
        "jarque_bera double, jarque_bera_p double, n_total long",
    )


def _shapiro(df: DataFrame, columns, key, seed: int, shares: dict[int, float], size: int) -> dict[int, tuple]:
    """(W, p, values taken) per column index in ``shares``. Rows whose hash is above a column's
    share are dropped where they are read, so a bounded number is ranked."""
    if key:
        place = F.xxhash64(F.lit(seed), *[col(k) for k in key])
        uniform = place / F.lit(2.0**64) + F.lit(0.5)
    else:
        uniform = F.rand(seed)
    named = [
        F.struct(F.lit(i).alias("i"), as_double(df, columns[i]).alias("v"), F.lit(share).alias("share"))
        for i, share in shares.items()
    ]
    stacked = df.select(uniform.alias("o"), F.inline(F.array(*named)))
    stacked = stacked.filter(F.col("v").isNotNull() & (F.col("o") <= F.col("share")))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("o", "v"))
    sample = stacked.withColumn("rank", rank).filter(F.col("rank") <= size).select("i", "v")

    def test(part: pd.DataFrame) -> pd.DataFrame:
        n = len(part)
        w, p = special.shapiro_wilk(part["v"].to_numpy()) if n >= 3 else (None, None)
        return pd.DataFrame({"i": [part["i"].iloc[0]], "w": [w], "p": [p], "n": [n]})

    tested = sample.groupBy("i").applyInPandas(test, "i int, w double, p double, n long").collect()
    return {r["i"]: (r["w"], r["p"], r["n"]) for r in tested}


def correlation_test(
    df: DataFrame, first: str, second: str, method: str = "pearson", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Pearson, Spearman or Kendall (tau-b) correlation of complete rows, with p."""
    if method not in ("pearson", "spearman", "kendall"):
        raise AnalysisError("method must be pearson, spearman or kendall")
    require_numeric(df, first, second)
    pairs = df.select(as_double(df, first).alias("x"), as_double(df, second).alias("y")).na.drop()
    r = p = None
    if method == "pearson":
        statistics = pair_statistics(pairs, ["x", "y"])["x", "y"]
        n = statistics[0]
        r = pearson(statistics) if n >= 3 else None
    else:
        n = pairs.count()
    if n < 3:
        raise AnalysisError("Insufficient data")
    if method == "spearman":
        r = spearman_r(pairs, n, rows_per_task)
    if method == "kendall":
        r, p = _kendall(pairs, n, rows_per_task)
    elif r is not None:
        p = special.correlation_p(r, n)
    return result_frame(
        df.sparkSession,
        [(method, first, second, r, p, p is not None and p < ALPHA, n)],
        "method string, column1 string, column2 string, coefficient double, p_value double, significant boolean, n long",
    )


def _kendall(pairs: DataFrame, n: int, rows_per_task: int) -> tuple[float | None, float | None]:
    x_pairs, x0, x1 = tie_sums(pairs, ["x"])
    y_pairs, y0, y1 = tie_sums(pairs, ["y"])
    both, _, _ = tie_sums(pairs, ["x", "y"])
    total = n * (n - 1) / 2
    if x_pairs == total or y_pairs == total:
        return None, None
    discordant = discordant_pairs(pairs, n, rows_per_task)
    surplus = total - x_pairs - y_pairs + both - 2 * discordant
    tau = surplus / math.sqrt(total - x_pairs) / math.sqrt(total - y_pairs)
    smaller = min(discordant, total - discordant)
    if x_pairs == 0 and y_pairs == 0 and (n <= 33 or smaller <= 1):
        return max(-1.0, min(1.0, tau)), special.inversions_two_sided(int(smaller), n)
    m = n * (n - 1.0)
    variance = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * x_pairs * y_pairs / m + x0 * y0 / (9 * m * (n - 2))
    return max(-1.0, min(1.0, tau)), 2 * special.normal_upper(abs(surplus) / math.sqrt(variance))


def correlations_with_p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r and p of every pair with more than two complete rows."""
    out = []
    for (a, b), s in pair_statistics(df, columns).items():
        if s[0] > 2:
            r = pearson(s)
            p = special.correlation_p(r, s[0]) if r is not None else None
            out.append((a, b, r, p, p is not None and p < ALPHA, s[0]))
    return result_frame(
        df.sparkSession,
        out,
        "column1 string, column2 string, correlation double, p_value double, significant boolean, n long",
    )


def overview(df: DataFrame, key: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Normality of all numeric columns; correlations of all their pairs."""
    numeric = numeric_columns(df)
    if not numeric:
        raise AnalysisError("No numeric columns")
    tests = normality(df, numeric, key)
    return tests, correlations_with_p(df, numeric)


def ab_test(
    df: DataFrame, variant_column: str, converted: str, control, variant, alpha: float = ALPHA
) -> DataFrame:
    """Two-proportion z-test between two arms of an experiment table."""
    require(df, variant_column, converted)
    arms = (
        df.filter(col(variant_column).isin([control, variant]))
        .groupBy(col(variant_column).alias("arm"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(col(converted).cast("boolean")).alias("k"))
        .collect()
    )
    found = {r["arm"]: (r["k"], r["n"]) for r in arms}
    return ab_counts(df.sparkSession, *found.get(control, (0, 0)), *found.get(variant, (0, 0)), alpha)


def ab_counts(spark, control_conversions, control_total, variant_conversions, variant_total, alpha=ALPHA) -> DataFrame:
    """The same test from four counts."""
    try:
        c1, n1, c2, n2 = int(control_conversions), int(control_total), int(variant_conversions), int(variant_total)
        alpha = float(alpha)
    except (TypeError, ValueError) as error:
        raise AnalysisError("Inputs must be numeric") from error
    if n1 <= 0 or n2 <= 0:
        raise AnalysisError("Totals must be positive")
    if min(c1, c2) < 0 or c1 > n1 or c2 > n2:
        raise AnalysisError("Conversions must be between zero and the total")
    if not 0 < alpha < 1:
        raise AnalysisError("alpha must be between 0 and 1")
    p1, p2 = c1 / n1, c2 / n2
    lift = p2 - p1
    pooled = (c1 + c2) / (n1 + n2)
    error = math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    if error == 0:
        raise AnalysisError("Standard error is zero, cannot compute the z-test")
    z = lift / error
    p = 2 * special.normal_upper(abs(z))
    reach = special.normal_quantile(1 - alpha / 2) * math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    winner = "inconclusive" if p >= alpha else "variant" if lift > 0 else "control" if lift < 0 else "tie"
    row = (c1, n1, p1, c2, n2, p2, lift, lift / p1 * 100 if p1 > 0 else None, z, p, alpha, p < alpha, lift - reach, lift + reach, winner)
    return result_frame(
        spark,
        [row],
        "control_conversions long, control_total long, control_rate double, variant_conversions long, "
        "variant_total long, variant_rate double, lift_absolute double, lift_relative_percent double, "
        "z_statistic double, p_value double, alpha double, significant boolean, ci_low double, ci_high double, "
        "winner string",
    )
