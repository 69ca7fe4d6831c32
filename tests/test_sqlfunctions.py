"""Functions and statements of free SQL against the column functions they stand for, and by hand."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from civiclake.functions import geometry as g
from civiclake.functions.sqlfunctions import needed, ordered_lists
from civiclake.operators.freesql import InvalidQuery, run_sql
from tests.test_geometry import CONCAVE, FAR, HOLE, INSIDE, LINE, LOOP, MIXED, NESTED, TWO

SHAPES = [HOLE, CONCAVE, TWO, LINE, LOOP, MIXED, NESTED, "POINT (3 4)", "MULTIPOINT (1 1, 2 2)", "POLYGON EMPTY", "POINT EMPTY", None, "polygon((-1e1 -.5,10 -.5,10 +5.,-10 5,\t-10 -.5))"]


def test_spatial_functions_equal_the_column_functions(spark):
    r = random.Random(4)
    points = [(x, y) for _, x, y, _ in [*INSIDE, *FAR]] + [(r.randint(-2, 12), r.randint(-2, 12)) for _ in range(30)]
    rows = [(i * 1000 + j, w, float(x), float(y)) for i, w in enumerate(SHAPES) for j, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, wkt string, x double, y double")
    df.createOrReplaceTempView("asked")
    got = {tuple(r) for r in run_sql(spark, "SELECT id, ST_Contains(ST_GeomFromText(wkt), ST_Point(x, y)), st_within(st_point(x, y), wkt), ROUND(ST_DISTANCE(wkt, ST_POINT(x, y)), 9), "
                                     "ROUND(st_distance(st_point(x, y), wkt), 9) FROM asked", cap=None).collect()}
    shape = g.parse_wkt(F.col("wkt"))
    inside, away = g.contains_point(shape, F.col("x"), F.col("y")), F.round(g.distance(shape, F.col("x"), F.col("y")), 9)
    assert got == {(*tuple(r)[:2], *tuple(r)[1:], r[2]) for r in df.select("id", inside, away).collect()}


APART = [
    ("LINESTRING (0 0, 10 10)", "LINESTRING (0 10, 10 0)", 0.0), ("LINESTRING (0 0, 10 0)", "LINESTRING (3 4, 12 4)", 4.0),
    (HOLE, "POLYGON ((4.5 4.5, 5.5 4.5, 5.5 5.5, 4.5 5.5, 4.5 4.5))", 0.5), (HOLE, "POLYGON ((1 1, 2 1, 2 2, 1 1))", 0.0),
    (HOLE, "POLYGON ((-50 -50, 50 -50, 50 50, -50 50, -50 -50))", 0.0), (TWO, "LINESTRING (3 3, 3 4)", math.sqrt(2)), (HOLE, "POLYGON EMPTY", None),
    ("POINT (0 0)", "POINT (3 4)", 5.0), ("MULTIPOINT (0 0, 9 9)", "MULTIPOINT (3 4, 50 50)", 5.0), (None, "POINT (1 1)", None),
]


def test_distance_of_any_two_shapes(spark):
    spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(APART)], "i int, a string, b string").createOrReplaceTempView("pairs")
    for one, two in (("a", "b"), ("b", "a")):
        got = [r["d"] for r in run_sql(spark, f"SELECT i, ST_Distance({one}, {two}) AS d FROM pairs ORDER BY i").collect()]
        assert got == [None if d is None else pytest.approx(d) for _, _, d in APART]


def test_functions_are_inlined_and_leave_no_trace(spark):
    spark.range(5).selectExpr("id", "concat('POINT (', id, ' 0)') AS wkt").createOrReplaceTempView("spots")
    df = run_sql(spark, "SELECT id FROM spots WHERE ST_DISTANCE(wkt, ST_POINT(2, 0)) <= 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "civiclake" not in plan and "Python" not in plan
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]
    assert not any(spark.catalog.functionExists(n) for n in ("st_distance", "civiclake_shape", "epoch"))
    spark.sql("CREATE TEMPORARY FUNCTION epoch(x INT) RETURNS INT RETURN x + 1")
    try:
        assert run_sql(spark, "SELECT EPOCH(41) AS a").first()["a"] == 42  # the session's own stays
        assert spark.catalog.functionExists("epoch")
    finally:
        spark.sql("DROP TEMPORARY FUNCTION epoch")
    with pytest.raises(Exception):
        run_sql(spark, "SELECT ST_POINT(nothing, 1) FROM spots")
    assert not spark.catalog.functionExists("st_point")
    assert needed("select 1") == [] and needed("SELECT st_point (1, 2)") == ["st_point"]


def test_epoch_and_json(spark):
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 59, 500000), '{"a": {"b": 7}, "c": "x"}'), (dt.datetime(2024, 2, 29, 12), '{"c": null}'), (None, "no json"), (None, None)]
    spark.createDataFrame(rows, "t timestamp_ntz, j string").createOrReplaceTempView("moments")
    got = [tuple(r) for r in run_sql(spark, "SELECT EPOCH(t), EPOCH(CAST(t AS DATE)), json_extract_string(j, '$.a.b'), json_extract_string(j, '/a/b'), json_extract_string(j, 'c') FROM moments").collect()]
    assert got == [(-0.5, -86400.0, "7", "7", "x"), (1709208000.0, 1709164800.0, None, None, None), (None,) * 5, (None,) * 5]


@pytest.mark.parametrize("given,want", [
    ("SELECT string_agg(a, ',' ORDER BY b DESC, c) FROM t", "SELECT string_agg(a, ',' ) WITHIN GROUP (ORDER BY b DESC, c) FROM t"),
    ("select STRING_AGG (DISTINCT f(a, (1)), ')' order by a) filter (where x) from t", "select STRING_AGG (DISTINCT f(a, (1)), ')' ) WITHIN GROUP (order by a) filter (where x) from t"),
    ("SELECT string_agg(a, ',') WITHIN GROUP (ORDER BY a), x.string_agg FROM t ORDER BY 1", None),
    ("SELECT 'string_agg(a ORDER BY b)', \"string_agg(a ORDER BY b)\" -- string_agg(a ORDER BY b)\n", None),
    ("SELECT string_agg(a, (SELECT max(z) FROM u WHERE k IN (SELECT k FROM v ORDER BY k)) ORDER BY a) FROM t",
     "SELECT string_agg(a, (SELECT max(z) FROM u WHERE k IN (SELECT k FROM v ORDER BY k)) ) WITHIN GROUP (ORDER BY a) FROM t"),
])
def test_ordered_lists(given, want):
    assert ordered_lists(given) == (want or given)


def test_summarize(spark):
    spark.createDataFrame([(1, "a"), (2, None), (4, "c")], "n int, `a word` string").createOrReplaceTempView("few")
    for text in ("SUMMARIZE few", "-- note\nsummarize SELECT * FROM \"few\"", "/* x */ Summarize (SELECT * FROM few)", "SUMMARIZE WITH w AS (SELECT * FROM few) SELECT * FROM w"):
        got = {r["column_name"]: r for r in run_sql(spark, text).collect()}
        assert set(got) == {"n", "a word"} and got["n"]["max"] == "4" and got["n"]["count"] == 3
    with pytest.raises(InvalidQuery) as caught:
        run_sql(spark, "SUMMARIZE few; DROP TABLE few")
    assert caught.value.reason == "semicolons"
