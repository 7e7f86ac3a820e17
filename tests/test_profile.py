import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon import AnalysisError
from tabulon.operators import compare, insights, profile, quality, types
from tabulon.operators.clean import Cleaner, snake_case
from tabulon.operators.features import Features, interval_labels, width_edges


def test_single_row_has_no_deviation(spark):
    found = profile.column_analysis(spark.createDataFrame([(1, 2)], "a long, b long")).collect()
    assert [r["std"] for r in found] == [None, None]
    assert [r["mean"] for r in found] == [1.0, 2.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    report = compare.full_report(df).to_dict()
    assert report["basic_info"]["rows"] == 0
    assert report["quality_score"]["missing_data"] == 100.0
    assert all(c["missing_percent"] == 0 for c in report["column_analysis"])


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([("x", 1.0), (None, 1.0), ("x", None)], "s string, v double")
    found = {r["name"]: r for r in profile.column_analysis(df).collect()}
    assert found["s"]["unique_count"] == 2 and found["v"]["unique_count"] == 2
    top = profile.top_values(df).collect()
    assert [(r["value"], r["count"]) for r in top] == [("x", 2), ("None", 1)]
    assert [f.name for f in Cleaner(df).drop_constant_columns().df.schema] == []


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a long, b double")
    row = profile.column_analysis(df).filter("name = 'b'").first()
    assert row["mean"] is None and row["unique_count"] == 1
    assert profile.detect_outliers(df).count() == 1
    assert quality.assess(df).constant_columns == 1


def test_longs_above_2_53_stay_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "a long")
    assert profile.column_analysis(df).first()["unique_count"] == 2


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], ["a.b c", "q`r"])
    assert [r["name"] for r in profile.column_analysis(df).collect()] == ["a.b c", "q`r"]
    assert Cleaner(df).impute_mean().df.columns == ["a.b c", "q`r"]


@pytest.mark.parametrize("score,letter", [(90, "A"), (89.99, "B"), (80, "B"), (70, "C"), (60, "D"), (59.9, "F")])
def test_grades(score, letter):
    assert quality.grade(score) == letter


def test_quality_radar_agrees_with_score(lineitem):
    scores = quality.quality_score(lineitem).first().asDict()
    radar = {r["dimension"]: r["score"] for r in quality.quality_radar(lineitem).collect()}
    assert radar["Type Consistency"] == scores["type_consistency"] and len(radar) == 5


def test_type_detection(spark):
    rows = [(f"2024-01-{i % 28 + 1:02d}", f"{i},000.5", str(i), "Yes" if i % 3 else "no", "12") for i in range(60)]
    df = spark.createDataFrame(rows, "d string, n string, i string, b string, twelve string")
    assert [r["column"] for r in types.detect_datetime(df).collect()] == ["d"]
    kinds = {r["column"]: r["suggested_type"] for r in types.detect_numeric_strings(df).collect()}
    assert kinds == {"n": "float64", "i": "int64", "twelve": "int64"}
    assert [r["column"] for r in types.detect_boolean(df).collect()] == ["b"]
    assert [r["column"] for r in types.detect_categorical(df).collect()] == ["b"]


def test_suggestions_can_be_applied(spark):
    rows = [(float(i) if i % 5 else None, f"2024-01-{i % 28 + 1:02d}") for i in range(100)]
    df = spark.createDataFrame(rows + rows, "v double, d string")
    found = insights.cleaning_suggestions(df)
    ids = [r["id"] for r in found.orderBy("rank").collect()]
    assert ids[0] == "remove-duplicates" and "impute-v" in ids and "cast-datetime-d" in ids
    done = insights.apply_suggestions(df, found)
    assert dict(done.dtypes)["d"] == "timestamp_ntz"
    assert done.filter("v IS NULL").count() == 0 and done.count() < df.count()


def test_history_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    report = compare.full_report(df)
    path = str(tmp_path / "history")
    assert [compare.append_profile(report, path, k) for k in ("a", "a", "b")] == [1, 2, 1]
    assert [r["version"] for r in compare.profile_history(spark, path, "a").collect()] == [2, 1]


def test_schema_diff(spark):
    one, two = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, c int")
    row = compare.schema_diff(one, two).first()
    assert (row["first_only"], row["second_only"], row["common"]) == (["a"], ["c"], ["b"])


@pytest.mark.parametrize(
    "name,expected",
    [("Order ID", "order_id"), ("customerName", "customer_name"), ("HTTPServer.v2", "http_server_v2"), ("__A-b c!", "a_b_c")],
)
def test_snake_case(name, expected):
    assert snake_case(name) == expected


def test_snake_case_collision(spark):
    with pytest.raises(AnalysisError):
        Cleaner(spark.createDataFrame([(1, 2)], ["a b", "a-b"])).rename_columns_snake_case()


def test_ordered_steps_need_an_order(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, v double")
    with pytest.raises(AnalysisError):
        Cleaner(df).impute_forward_fill()
    with pytest.raises(AnalysisError):
        Features(df).rolling_stats("v")


def test_capped_table_has_no_outliers_beyond_the_same_bounds(orders):
    df = orders.select(F.pow(F.col("o_totalprice"), 4).alias("v"))
    step = Cleaner(df)
    low, high = step.iqr_bounds(["v"], 1.5)["v"]
    assert df.filter(F.col("v") > high).count() > 0
    capped = step.cap_outliers_iqr(["v"]).df
    assert capped.filter(~F.col("v").between(low, high)).count() == 0 and capped.count() == df.count()


def test_numeric_cast_guards(spark):
    rows = [("1,000",), ("1d",), (" 12 ",), ("1_0",), ("1e3",), ("-.5",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r["s"] for r in Cleaner(df).cast_to_numeric(["s"]).df.collect()] == [None, None, 12, None, 1000, -0.5, None, None]
    assert Cleaner(df).cast_to_numeric(["s"], strip_commas=True).df.first()["s"] == 1000


def test_strip_every_kind_of_space(spark):
    df = spark.createDataFrame([("\t  a b \n",)], "s string")
    assert Cleaner(df).strip_whitespace().df.first()["s"] == "a b"


def test_bins_follow_pandas(lineitem):
    pdf = lineitem.select("l_extendedprice", "l_quantity").toPandas()
    cut = pd.cut(pdf.l_extendedprice, 7)
    edges = width_edges(pdf.l_extendedprice.min(), pdf.l_extendedprice.max(), 7)
    assert interval_labels(edges) == [str(c) for c in cut.cat.categories]
    found = Features(lineitem).bin_equal_frequency("l_quantity", 5).df
    codes = pd.qcut(pdf.l_quantity, 5, labels=False, duplicates="drop").value_counts().to_dict()
    assert {r["l_quantity_qbin"]: r["count"] for r in found.groupBy("l_quantity_qbin").count().collect()} == codes


def test_constant_columns_in_features(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    done = Features(df).normalize_minmax(["v"]).standardize_zscore(["v"]).bin_equal_width("v", 2).df.collect()
    assert [r["v_norm"] for r in done] == [0.0, 0.0, 0.0] and [r["v_std"] for r in done] == [0.0, 0.0, 0.0]
    assert done[2]["v_bin"] is None and done[0]["v_bin"] is not None


def test_nan_cells(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    row = profile.column_analysis(df).first()
    assert row["missing_count"] == 0 and math.isnan(row["mean"]) and row["median"] == 2.0
    assert Cleaner(df).impute_mean().df.agg(F.sum("v")).first()[0] == 6.0


@pytest.mark.parametrize("rows", [9, 3000])
def test_outliers_counted_with_the_quartiles(spark, rows, monkeypatch):
    from tabulon.operators.profile import TableProfile

    rng = np.random.default_rng(rows)
    pdf = pd.DataFrame(
        {
            "heavy": rng.standard_t(2, rows),
            "whole": rng.geometric(0.2, rows).astype(float),
            "edge": np.where(np.arange(rows) % 5 == 0, 2.5, np.where(np.arange(rows) % 2 == 0, 0.0, 1.0)),
            "constant": 4.0,
            "holes": np.where(rng.random(rows) < 0.3, np.nan, rng.normal(size=rows) ** 3),
            "far": np.where(np.arange(rows) == 1, np.inf, rng.normal(size=rows)),
        }
    )
    df = spark.createDataFrame(pdf).repartition(4)
    expected = {}
    for n in pdf:
        v = pdf[n].dropna()
        q1, q3 = (np.percentile(v, p, method="midpoint") for p in (25, 75))
        expected[n] = int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
    for decided in (True, False):
        with TableProfile(df) as profile:
            if not decided:
                monkeypatch.setattr(TableProfile, "_outside", lambda *_: None)
            else:
                assert profile.quartiles and (rows < 100 or all(profile._watched.values()))
            assert {f["column"]: f["count"] for f in profile.outlier_rows} == expected
