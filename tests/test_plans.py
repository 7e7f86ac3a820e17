"""Exact selection, ordered windows and rank statistics, small pieces against brute force."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tabulon.operators.clean import Cleaner
from tabulon.operators.features import Features
from tabulon.plans.correlations import pearson, summarise
from tabulon.plans.duplicates import duplicate_rows
from tabulon.plans.quantiles import exact_quantiles, grouped_quantiles
from tabulon.plans.ranks import discordant_pairs, spearman_r, weighted_inversions

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(3, 2, 6000), 2)
    x[:2000] = 7.0
    y = np.round(x * 0.3 + rng.normal(size=6000) * 20, 1)
    pdf = pd.DataFrame({"x": x, "y": y, "g": np.where(np.arange(6000) < 4500, "hot", "cold")})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("limit", [200_000, 20, 0])
@pytest.mark.parametrize("kind", ["linear", "midpoint"])
def test_quantiles_match_numpy(skewed, limit, kind):
    pdf, df = skewed
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, ["x", "y"], probs, kind, collect_limit=limit)
    for name in ("x", "y"):
        expected = [np.percentile(pdf[name], p * 100, method=kind) for p in probs]
        assert np.allclose(list(found[name].values()), expected, rtol=1e-12)


def test_quantiles_of_odd_columns(spark):
    inf = float("inf")
    rows = [(1.0, None), (float("nan"), None), (inf, None), (-inf, None), (2.0, None), (5.0, None)]
    df = spark.createDataFrame(rows, "a double, b long")
    found = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], collect_limit=0)
    assert found["a"] == {0.25: 1.0, 0.5: 2.0, 0.75: 5.0}
    assert found["b"] == {0.25: None, 0.5: None, 0.75: None}
    empty = exact_quantiles(spark.createDataFrame([], "a double"), ["a"], [0.5])
    assert empty["a"][0.5] is None


def test_sketch_that_misses_is_corrected(skewed, monkeypatch):
    from tabulon.plans import quantiles

    pdf, df = skewed
    wrong = lambda probs: [0.6, 0.65] * len(probs)  # noqa: E731 - brackets that cannot hold the rank
    monkeypatch.setattr(quantiles, "sketch_probabilities", wrong)
    found = quantiles.exact_quantiles(df, ["x"], [0.25, 0.9])["x"]
    assert [found[0.25], found[0.9]] == [np.percentile(pdf.x, 25), np.percentile(pdf.x, 90)]


@pytest.mark.parametrize("rows_per_task", [10**6, 300])
def test_grouped_quantiles_with_hot_group(skewed, rows_per_task):
    pdf, df = skewed
    found = grouped_quantiles(df, ["g"], "x", [0.25, 0.5], ["a", "b"], rows_per_task=rows_per_task).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert math.isclose(found.loc[g, "a"], part.x.quantile(0.25))
        assert math.isclose(found.loc[g, "b"], part.x.quantile(0.5))


@pytest.mark.parametrize("rows_per_task", [10**6, 500])
@pytest.mark.parametrize("groups", [[], ["l_returnflag"]])
def test_ordered_steps_match_pandas(lineitem, rows_per_task, groups):
    pdf = lineitem.toPandas().sort_values([*ORDER, "l_quantity"]).reset_index(drop=True)
    keyed = pdf.groupby(groups) if groups else pdf.assign(k=1).groupby("k")
    options = {"partition_by": groups, "rows_per_task": rows_per_task}
    order = [*ORDER, "l_quantity"]
    done = Features(lineitem, order).rolling_stats("l_quantity", 5, **options).lag_features("l_quantity", [1, 7, -2], **options)
    found = done.df.toPandas().sort_values(order).reset_index(drop=True)
    expected = keyed.l_quantity.transform(lambda s: s.rolling(5, min_periods=1).mean())
    assert np.allclose(found["l_quantity_roll_mean_5"], expected)
    for k in (1, 7, -2):
        assert np.allclose(found[f"l_quantity_lag{k}"].fillna(-1), keyed.l_quantity.shift(k).fillna(-1))

    gaps = lineitem.withColumn("z", F.when(F.col("l_quantity") > 40, F.col("l_quantity")))
    filled = Cleaner(gaps, order).impute_forward_fill(["z"], **options).df
    found = filled.toPandas().sort_values(order).reset_index(drop=True)
    blank = pdf.l_quantity.where(pdf.l_quantity > 40)
    expected = blank.groupby([pdf[g] for g in groups]).ffill() if groups else blank.ffill()
    assert np.allclose(found.z.fillna(-1), expected.fillna(-1))


@pytest.fixture(scope="module")
def one_moment(spark):
    """Half of the rows stand on one timestamp; some of them are equal in every column."""
    rng = np.random.default_rng(8)
    t = np.r_[np.full(2000, 500), rng.integers(0, 1000, 2000)]
    v = pd.Series(rng.integers(0, 10**6, 4000), dtype="Int64").where(rng.random(4000) > 0.6)
    pdf = pd.DataFrame({"t": t, "v": v, "g": np.where(np.arange(4000) % 3 > 0, "hot", "cold")})
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "t long, v long, g string").repartition(6)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_half_the_rows_on_one_timestamp(one_moment, groups):
    from tabulon.functions.columns import row_hash
    from tabulon.plans import ordered

    df, size = one_moment, 200
    pieces, extra = ordered.cut(df, [*groups, "t"], df.count(), size)
    assert extra[0] == ordered.TIE
    assert pieces.groupBy(ordered.PIECE).count().agg(F.max("count")).first()[0] <= 3 * size

    spec = Window.partitionBy(*groups).orderBy("t", row_hash(df))
    expected = df.withColumns({"n": F.row_number().over(spec).cast("long"), "b": F.lag("v", 2).over(spec)})
    gaps = df.withColumn("f", F.col("v"))
    upto = Window.partitionBy(*groups).orderBy("t", row_hash(gaps)).rowsBetween(Window.unboundedPreceding, 0)
    fills = sorted_rows(gaps.withColumn("f", F.last("f", True).over(upto)), ["t", "v", "g", "f"])
    for rows_per_task in (10**6, size):
        options = {"partition_by": groups, "rows_per_task": rows_per_task}
        wide = ordered.with_positions(df, ["t"], name="n", **options)
        back = ordered.sliding(df, lambda w: {"b": F.lag("v", 2).over(w)}, ["t"], before=2, **options)
        last = ordered.fill_forward(gaps, ["f"], ["t"], **options)
        assert sorted_rows(wide, ["t", "v", "g", "n"]) == sorted_rows(expected, ["t", "v", "g", "n"])
        assert sorted_rows(back, ["t", "v", "g", "b"]) == sorted_rows(expected, ["t", "v", "g", "b"])
        assert sorted_rows(last, ["t", "v", "g", "f"]) == fills


def test_equal_rows_beyond_a_task(spark):
    from tabulon.plans import ordered

    df = spark.range(6000).select(F.lit(7).alias("t"), F.when(F.col("id") < 5000, 1).alias("v")).repartition(5)
    pieces, extra = ordered.cut(df, ["t"], 6000, 300)
    assert extra == [ordered.TIE, ordered.SALT]
    assert pieces.groupBy(ordered.PIECE).count().agg(F.max("count")).first()[0] <= 900
    placed = ordered.with_positions(df, ["t"], rows_per_task=300)
    assert placed.columns == ["t", "v", ordered.POSITION]
    found = sorted(r[ordered.POSITION] for r in placed.collect())
    assert found == list(range(1, 6001))
    assert ordered.fill_forward(df, ["v"], ["t"], rows_per_task=300).filter("v is null").count() in (0, 1000)


def sorted_rows(df, names):
    return sorted(df.select(*names).collect(), key=lambda r: [(x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r])


LONG = "the same first thirty-two bytes of many texts "


def top_by_hand(values, k):
    sizes = Counter(values)
    best = sorted(sizes.items(), key=lambda x: (-x[1], x[0] is not None, (x[0] or "").encode()))
    return len(sizes), best[:k]


@pytest.mark.parametrize("clash", [None, "seen by the checksum", "seen in the texts"])
def test_values_by_fingerprints(spark, monkeypatch, clash):
    from tabulon.plans import value_counts as module

    if clash:
        monkeypatch.setattr(module, "_fingerprint", lambda text: (F.lit(1), F.lit(2)))
    if clash == "seen in the texts":
        monkeypatch.setattr(module, "_checksum", lambda text: F.lit(3))
    texts = [LONG + "é" * i for i in range(5)] * 3 + [LONG + "y" * 400] * 40 + [LONG[:32], "", None, None, "a"]
    texts += ["\U0001f600" * 9, "\U0001f600" * 8, "\uffff" * 11, "ab" * 5000]
    numbers = [i % 7 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, numbers)), "s string, n int").repartition(3)
    distinct, tops = module.distinct_and_top(df, ["s", "n"], ["s"], k=10)
    size, best = top_by_hand(texts, 10)
    assert (distinct, tops["s"]) == ({"s": size, "n": 7}, best)
    if clash != "seen in the texts":
        assert module.distinct_non_null(df, ["n", "s"]) == {"n": 7, "s": size - 1}


@pytest.mark.parametrize("shared", [40, 2000])
def test_ties_far_into_long_texts(spark, shared):
    from tabulon.plans.value_counts import distinct_and_top

    texts = ["x" * shared + f"{i * 7919 % 1000:04d}" + "z" * 300 for i in range(1000)] + ["x" * shared]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(4)
    distinct, tops = distinct_and_top(df, ["s"], ["s"], k=10)
    assert (distinct["s"], tops["s"]) == top_by_hand(texts, 10)
    assert distinct_and_top(df.limit(0), ["s"], ["s"]) == ({"s": 0}, {"s": []})


def test_no_long_text_is_shuffled(spark):
    """What the count hands to the shuffle is at most HEAD characters of a text."""
    from tabulon.plans.value_counts import HEAD, value_counts

    df = spark.createDataFrame([("q" * 5000,), ("r" * 31,)], "s string")
    longest = value_counts(df, ["s"]).agg(F.max(F.octet_length("head"))).first()[0]
    assert longest == HEAD


def test_weighted_inversions():
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 9, 200), rng.integers(0, 9, 200), rng.integers(1, 4, 200)
    expected = sum(w[i] * w[(x > x[i]) & (y < y[i])].sum() for i in range(200))
    assert weighted_inversions(x, y, w) == expected


@pytest.mark.parametrize("rows_per_task", [10**6, 700, 150])
def test_ranks_with_ties(skewed, rows_per_task):
    pdf, df = skewed
    x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
    pairs = df.select("x", "y")
    expected = float(sum(((x > x[i]) & (y < y[i])).sum() for i in range(len(x))))
    assert discordant_pairs(pairs, len(x), rows_per_task) == expected
    r = np.corrcoef(pdf.x.rank(), pdf.y.rank())[0, 1]
    assert math.isclose(spearman_r(pairs, len(x), rows_per_task), r, rel_tol=1e-9)


def test_bins_too_large_for_a_task_are_cut_again(skewed, monkeypatch):
    from tabulon.plans import ranks

    pdf, df = skewed
    x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
    monkeypatch.setattr(ranks, "BINS_PER_GROUP", 3)
    expected = float(sum(((x > x[i]) & (y < y[i])).sum() for i in range(len(x))))
    assert discordant_pairs(df.select("x", "y"), len(x), 300) == expected


def test_moments_and_pairs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, 500), "b": rng.gamma(2, size=500), "c": 0.1, "d": np.nan})
    pdf.loc[::7, "b"] = np.nan
    moments, pairs = summarise(spark.createDataFrame(pdf).repartition(4), list("abcd"))
    for n in "ab":
        assert math.isclose(moments[n].variance, pdf[n].var(), rel_tol=1e-8)
        centred = pdf[n] - pdf[n].mean()
        assert math.isclose(moments[n].skewness, (centred**3).mean() / (centred**2).mean() ** 1.5, rel_tol=1e-6)
    assert moments["c"].variance == 0 and moments["c"].skewness is None
    assert moments["d"].n == 0 and moments["d"].mean is None
    assert math.isclose(pearson(pairs["a", "b"]), pdf.a.corr(pdf.b), rel_tol=1e-7)
    assert pearson(pairs["a", "c"]) is None and pearson(pairs["a", "d"]) is None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_duplicates_keep_nulls_apart(spark, limit):
    rows = [(None, 1), (1, None), (1, None), (None, None), (None, None), (None, None), (2, 3)]
    assert duplicate_rows(spark.createDataFrame(rows, "a int, b int"), limit) == 3
    maps = spark.createDataFrame([({"x": 1, "y": 2},), ({"y": 2, "x": 1},)], "m map<string,int>")
    assert duplicate_rows(maps, limit) == 1


def test_results_do_not_depend_on_partitions(lineitem):
    from tabulon.operators.profile import column_analysis

    first = column_analysis(lineitem.repartition(1)).collect()
    assert first == column_analysis(lineitem.repartition(13)).collect()
