"""Work and memory that must not outgrow the rows."""

import math

from pyspark.sql import functions as F

from tabulon.operators import sql
from workload import ORACLES, QUERIES

PARTS = "p_partkey long, p_brand string, p_retailprice double"


def _parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, PARTS).write.parquet(f"{tmp_path}/part.parquet")
    return spark.read.parquet(f"{tmp_path}/part.parquet")


def test_range_counts_equal_the_plain_join(spark, tmp_path):
    prices = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5.0, -5.0, 4.999, 10.0, 10.000001, 1e17, 1e300, -1e300, 0.1, 5.1, 5.1]
    rows = [(i % 13 if i % 7 else None, brand, price) for brand in ("x", "y", None) for i, price in enumerate(prices * 2)]
    rows += [(i, "z", 900 + i * 37 % 1000 / 10) for i in range(3000)]
    df = _parts(spark, tmp_path, rows)
    plain = ORACLES["sql_range_join"].replace(" part ", " df ")
    wanted = sorted(map(str, sql.sql_frame(df, plain).collect()))
    assert sorted(map(str, QUERIES["sql_range_join"](spark, str(tmp_path)).collect())) == wanted


def test_range_join_forms_no_pairs(spark, tmp_path):
    _parts(spark, tmp_path, [(i, "z", i / 100) for i in range(2000)])
    frame = QUERIES["sql_range_join"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line]
    assert joins and not any("<=" in line or ">=" in line for line in joins)


def _pairs_of_aggregates(plan):
    """Aggregates on either side of the first shuffle."""
    before, shuffle, after = plan.partition("Exchange")
    assert shuffle
    return before.count("HashAggregate"), after.count("HashAggregate")


def test_distinct_values_are_not_held_before_the_shuffle(spark):
    """Counts are combined in stretches: no map of all the values of a task stands before the shuffle."""
    from tabulon.plans.value_counts import value_counts

    df = spark.range(0, 3_000_000, numPartitions=2).selectExpr("id", "cast(id % 5 as double) AS five", "nullif(id % 2, 0) AS hole")
    counts = value_counts(df, ["id", "five", "hole"])
    assert _pairs_of_aggregates(counts._jdf.queryExecution().executedPlan().toString()) == (2, 0)
    found = counts.groupBy("column_index").agg(F.count("*"), F.sum("count")).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {0: (3_000_000, 3_000_000), 1: (5, 3_000_000), 2: (2, 3_000_000)}


def test_stretches_of_any_size_give_the_same_counts(spark, monkeypatch):
    from tabulon.plans import tallies
    from tabulon.plans.duplicates import duplicate_rows
    from tabulon.plans.value_counts import value_counts

    rows = [(0.0, None, None), (-0.0, None, "x" * 40), (math.nan, 1, "x" * 41), (math.nan, 1, "x" * 41), (None, None, None)] * 50
    df = spark.createDataFrame(rows, "d double, n int, t string").repartition(3)
    monkeypatch.setattr(tallies, "STRETCH_ROWS", 7)
    assert duplicate_rows(df) == 246
    found = sorted((r["column_index"], r["count"]) for r in value_counts(df, df.columns).collect())
    assert found == [(0, 50), (0, 100), (0, 100), (1, 100), (1, 150), (2, 50), (2, 100), (2, 100)]


def test_duplicates_hold_no_fingerprints_before_the_shuffle(spark, monkeypatch):
    from tabulon.plans import duplicates

    plans = []

    def watched(*args):
        out = tallies_summed(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    tallies_summed = duplicates.summed
    monkeypatch.setattr(duplicates, "summed", watched)
    assert duplicates.duplicate_rows(spark.range(200_000).selectExpr("id DIV 2 AS x")) == 100_000
    assert [_pairs_of_aggregates(p) for p in plans] == [(2, 0)]
