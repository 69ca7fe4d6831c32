"""Numbers kept as text, profiles and quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclake.operators.profile import duplicate_rows, profile, quality_report
from civiclake.operators.quantiles import exact_quantiles
from civiclake.operators.profile import profile
from civiclake.operators.typing_repair import detect_numeric_strings, infer_types, repair_numeric, sample_values


def test_numeric_text_becomes_double(spark):
    df = spark.createDataFrame(
        [("2020", "Alice", "100.5"), ("2021", "Bob", "200.3"), ("2022", "Charlie", "300.1")], "year string, name string, amount string")
    assert dict(repair_numeric(df).dtypes) == {"year": "double", "name": "string", "amount": "double"}


def test_commas(spark):
    df = spark.createDataFrame([("1,234,567", "A"), ("2,345,678", "B"), ("3,456,789", "C")], "award string, name string")
    out = repair_numeric(df)
    assert dict(out.dtypes)["award"] == "double"
    assert out.agg(F.min("award")).first()[0] == 1234567.0


def test_other_values_become_null(spark):
    rows = [(str(v),) for v in range(100, 1000, 100)] + [("N/A",)]
    out = repair_numeric(spark.createDataFrame(rows, "value string"))
    assert out.where("value is null").count() == 1
    assert out.where("value = 500").count() == 1


def test_threshold_is_strict(spark):
    eight_of_ten = [(str(i),) for i in range(8)] + [("x",), ("y",)]
    assert dict(repair_numeric(spark.createDataFrame(eight_of_ten, "v string")).dtypes)["v"] == "string"
    nine_of_eleven = [(str(i),) for i in range(9)] + [("x",), ("y",)]
    assert dict(repair_numeric(spark.createDataFrame(nine_of_eleven, "v string")).dtypes)["v"] == "double"


def test_empty_blank_and_odd_names(spark):
    df = spark.createDataFrame([(None, " ", "1d", "5"), (None, "", "2d", " 6 ")], "a string, b string, c string, `Min Delay.x` string")
    out = repair_numeric(df)
    assert [k for _, k in out.dtypes] == ["string", "string", "string", "double"]
    assert [r[3] for r in out.orderBy(out.columns[3].join("``")).collect()] == [5.0, 6.0]


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("v"), F.lit("same").alias("w"))
    first = sorted(tuple(r) for r in sample_values(df, ["v", "w"], 100).collect())
    again = sorted(tuple(r) for r in sample_values(df.repartition(7), ["v", "w"], 100).collect())
    assert first == again
    assert len([r for r in first if r[0] == "v"]) == 100 and ("w", "same") in first
    verdicts = {r["column"]: r["is_numeric"] for r in detect_numeric_strings(df).collect()}
    assert verdicts == {"v": True, "w": False}


def test_every_value_decides_and_commas_go_per_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 200 == 7, F.concat(F.lit("7,"), F.lpad(F.col("id").cast("string"), 4, "0").substr(2, 3)))
                                  .otherwise(F.col("id").cast("string")).alias("v"))
    out = repair_numeric(df)
    assert out.dtypes == [("v", "double")] and out.where("v is null").count() == 0
    assert out.where("v >= 7000 and v < 8000").count() == 25


def test_profile_of_an_empty_table(spark):
    got = profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r["column_name"], r["count"], r["null_percentage"]) for r in got] == [("a", 0, None), ("b", 0, None)]


def test_infer_types(spark):
    df = spark.createDataFrame([
        ("1", "1", "1.5", "True", "2024-01-01", "NA", "1,000"), ("2", "n/a", "-2e3", "False", "2024-01-02", "", "2,000")],
        "a string, b string, c string, d string, e string, f string, g string")
    out = infer_types(df)
    assert [k for _, k in out.dtypes] == ["bigint", "double", "double", "boolean", "string", "double", "string"]
    assert [tuple(r) for r in out.orderBy("a").collect()][1] == (2, None, -2000.0, False, "2024-01-02", None, "2,000")


def test_duplicates_count_all_members(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a"), (3, "b"), (3, "b")], "x int, y string")
    assert duplicate_rows(df).first()[0] == 5
    assert tuple(quality_report(df).first()) == (6, 5)


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 4.0), (3, "a", 2.0), (4, None, 6.0)], "n int, s string, d double")
    got = {r["column_name"]: r.asDict() for r in profile(df).collect()}
    assert got["s"]["null_percentage"] == 25.0 and got["s"]["min"] == "a" and got["s"]["avg"] is None
    assert got["n"]["avg"] == 2.5 and got["n"]["count"] == 4 and got["n"]["q50"] == "2"
    assert got["d"]["std"] == pytest.approx(2.0) and got["d"]["approx_unique"] == 3


def test_profile_of_a_wide_table(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(230)])
    assert profile(wide).count() == 230


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(3, 4, 4000), np.full(2500, 7.0), -rng.random(500)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["v"], probs, buckets=16).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
