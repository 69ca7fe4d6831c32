"""Exact quantiles by refinement, duplicates by hashes first, and statistics kept per file."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclake.operators import quantiles
from civiclake.operators.profile import duplicate_rows, quality_report, repeated_rows
from civiclake.operators.quantiles import exact_quantiles
from civiclake.operators.statistics import profile_merged, update_statistics


@pytest.mark.parametrize("buckets,small", [(2, 1), (3, 5), (16, 50), (512, 2_000)])
def test_quantiles_through_many_rounds(spark, buckets, small):
    rng = np.random.default_rng(buckets)
    a = np.concatenate([rng.lognormal(0, 6, 700), np.full(900, 2.5), -rng.lognormal(0, 6, 300), np.zeros(100)])
    b = np.concatenate([np.full(1990, 1.0), rng.random(10)])
    df = spark.createDataFrame([(float(x), float(y), 7 if i % 2 else None, None) for i, (x, y) in enumerate(zip(a, b))], "a double, `b c` double, part int, column string").repartition(6)
    probs = [0.0, 0.003, 0.2, 0.5, 0.777, 1.0]
    got = {(r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["a", "b c", "part"], probs, buckets=buckets, small=small).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile(a, p), rel=1e-12, abs=1e-300)
        assert got["b c", p] == pytest.approx(np.quantile(b, p), rel=1e-12)
        assert got["part", p] == 7.0


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(float("nan"), None, 1.0), (float("inf"), None, 1.0), (-math.inf, None, 1.0), (1.0, None, 1.0)], "n double, none double, same double")
    got = {(r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["n", "none", "same"], [0.0, 0.5, 1.0], buckets=4, small=1).collect()}
    assert got["n", 0.0] == -math.inf and math.isnan(got["n", 1.0]) and got["same", 0.5] == 1.0
    assert not any(c == "none" for c, _ in got)
    assert exact_quantiles(df.limit(0), ["n"], [0.5]).count() == 0


def test_no_partition_holds_much_more_than_the_mean(spark, monkeypatch):
    """A million different values: what leaves the tasks is a row per task and interval, and at last the values of small intervals."""
    df = spark.range(1_000_000, numPartitions=8).select(F.pow(F.col("id") / 1e5, 9).alias("v"))
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    got = exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])
    monkeypatch.undo()
    assert max(map(len, seen)) <= 6 * quantiles.SMALL and len(seen) >= 3
    want = np.quantile((np.arange(1_000_000) / 1e5) ** 9, [0.25, 0.5, 0.75])
    assert [r["quantile"] for r in got.orderBy("prob").collect()] == pytest.approx(list(want), rel=1e-9)


def test_duplicates_are_told_by_value(spark):
    rows = [(1, None, 0.0, {"k": 1}, [0.0]), (1, None, -0.0, {"k": 1}, [-0.0]), (None, 1, 0.0, {"k": 1}, [0.0]), (1, None, float("nan"), None, None), (1, None, float("nan"), None, None),
            (2, 2, 2.0, {}, []), (2, 2, 2.0, {"k": None}, [])]
    df = spark.createDataFrame(rows, "one int, two int, x double, m map<string,int>, copies array<double>")
    assert duplicate_rows(df).first()[0] == 4
    assert tuple(quality_report(df).first()) == (7, 4)
    plain = df.drop("m", "copies").withColumnRenamed("x", "row")
    assert sorted(tuple(r)[0::3] for r in repeated_rows(plain).collect()) == [(1, 2), (1, 2), (2, 2)]
    assert duplicate_rows(df.limit(0)).first()[0] == 0 and tuple(quality_report(df.limit(0)).first()) == (0, 0)


def test_unique_rows_are_not_shuffled_whole(spark, tmp_path):
    """The exchange of whole rows carries the repeated ones only."""
    wide = spark.range(20_000).select("id", F.repeat(F.lit("x"), 300).alias("text"))
    wide.union(wide.limit(50)).write.parquet(str(tmp_path / "wide"))
    df = repeated_rows(spark.read.parquet(str(tmp_path / "wide")))
    assert df.count() == 50
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(one" in plan


def write(spark, rows, path, parts):
    spark.createDataFrame(rows, "n long, x double, word string, day date, list array<int>").repartition(parts).write.mode("append").parquet(path)


def test_only_new_files_are_read_and_profiles_match(spark, tmp_path):
    table, kept = str(tmp_path / "a table%" / "t"), str(tmp_path / "stats")
    rng = np.random.default_rng(1)
    rows = [(int(i % 700), float(x) + 1e6, f"w{i % 90}" if i % 4 else None, None, [int(i % 3)]) for i, x in enumerate(rng.normal(0, 3, 6_000))] + [(None, float("nan"), "z", None, None)]
    write(spark, rows[:2_000], table, 3)
    assert len(update_statistics(spark, table, kept)) == 3
    assert update_statistics(spark, table, kept) == []
    write(spark, rows[2_000:], table, 2)
    assert len(update_statistics(spark, table, kept)) == 2
    got = {r["column_name"]: r.asDict() for r in profile_merged(spark, table, kept).collect()}
    assert list(got) == ["n", "x", "word", "day", "list"]
    values = np.array([r[1] for r in rows[:-1]])
    assert got["x"]["avg"] == pytest.approx(values.mean(), rel=1e-12) and got["x"]["std"] == pytest.approx(values.std(ddof=1), rel=1e-9)
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert np.quantile(values, q - 0.03) <= got["x"][name] <= np.quantile(values, q + 0.03)
    assert got["n"]["count"] == 6_001 and got["n"]["approx_unique"] == pytest.approx(700, rel=0.05) and (got["n"]["min"], got["n"]["max"]) == ("0.0", "699.0")
    assert got["word"]["approx_unique"] == pytest.approx(len({r[2] for r in rows} - {None}), rel=0.05) and got["word"]["max"] == "z" and got["word"]["q50"] is None
    assert float(got["word"]["null_percentage"]) == pytest.approx(25.0, abs=0.1) and got["day"]["min"] is None and got["day"]["approx_unique"] == 0


def test_files_that_are_gone_no_longer_count(spark, tmp_path):
    table, kept = str(tmp_path / "t"), str(tmp_path / "stats")
    write(spark, [(1, 1.0, "a", None, None)] * 5, table, 1)
    update_statistics(spark, table, kept)
    spark.createDataFrame([(9, 2.0, "b", None, None)] * 3, "n long, x double, word string, day date, list array<int>").coalesce(1).write.mode("overwrite").parquet(table)
    update_statistics(spark, table, kept)
    got = profile_merged(spark, table, kept).where("column_name = 'n'").first()
    assert (got["count"], got["min"], got["avg"]) == (3, "9.0", 9.0)
