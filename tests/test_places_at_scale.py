"""Counts per shape by cover, and the k nearest per probe, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civiclake.functions import geometry as g
from civiclake.operators.cover import count_in_shapes
from civiclake.operators.nearest_join import nearest_k_join
from civiclake.operators.spatial import spatial_join
from tests.test_geometry import CONCAVE, HOLE, LINE, LOOP, MIXED, TWO

POINTS = "lon double, lat double, shape string, id int"


def ring(r, x, y, size, n):
    """A star-shaped polygon around a place."""
    angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    corners = [(x + size * r.uniform(0.3, 1) * math.cos(a), y + size * r.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return "POLYGON ((" + ", ".join(f"{a!r} {b!r}" for a, b in [*corners, corners[0]]) + "))"


@pytest.mark.parametrize("crowded", [5, 2_000])
def test_counts_per_shape_against_all_pairs(spark, crowded):
    r = random.Random(crowded)
    shapes = [(i, w) for i, w in enumerate([HOLE, CONCAVE, TWO, LINE, LOOP, MIXED, "POINT (3 4)", None, "POLYGON EMPTY", "POLYGON ((0.07 0.07, 0.14 0.07, 0.14 0.14, 0.07 0.14, 0.07 0.07))"])]
    shapes += [(100 + i, ring(r, r.uniform(-20, 20), r.uniform(-20, 20), 10 ** r.uniform(-2, 1.7), r.randint(3, 40))) for i in range(40)]
    shapes += [(7, HOLE), (7, HOLE), (7, CONCAVE), (None, HOLE)]
    points = [(r.randint(0, 10) * 1.0, r.randint(0, 10) * 1.0) for _ in range(150)] + [(r.gauss(5, 3), r.gauss(5, 3)) for _ in range(600)]
    points += [(i / 100, j / 100) for i in range(5, 17) for j in range(5, 17)] + [(5.0, 1.0)] * 300 + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (500.0, 500.0)]
    given = spark.createDataFrame(shapes, "shape int, geometry_wkt string")
    spots = spark.createDataFrame([(x, y, "s", 1) for x, y in points], POINTS)
    pairs = given.where("shape is not null and geometry_wkt is not null").crossJoin(spots.select("lon", "lat"))
    inside = F.coalesce(g.contains_point(g.parse_wkt(F.col("geometry_wkt")), F.col("lon"), F.col("lat")) & ~F.isnan("lon"), F.lit(False))
    want = {x["shape"]: x["n"] for x in pairs.groupBy("shape").agg(F.count_if(inside).alias("n")).collect()}
    got = {x["shape"]: x["points"] for x in count_in_shapes(spots, given, "shape", crowded=crowded).collect()}
    assert got == want and sum(got.values()) > 1_000


def test_counts_per_shape_of_nothing(spark):
    given = spark.createDataFrame([(1, HOLE), (2, None)], "shape int, geometry_wkt string")
    none = spark.createDataFrame([], POINTS)
    assert [tuple(x) for x in count_in_shapes(none, given, "shape").collect()] == [(1, 0)]
    assert count_in_shapes(none, given.limit(0), "shape").count() == 0


def near_by_hand(probes, targets, k, km=None):
    out = set()
    for p, x, y in {q for q in probes if q[1] is not None and q[2] is not None}:
        found = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), t) for t, a, b in targets if a is not None and b is not None)
        found = [f for f in found if km is None or f[0] <= km / 111.0]
        out |= {(p, i, t, round(d * 111.0, 6)) for i, (d, t) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("k,km", [(1, None), (4, None), (4, 300.0), (500, None), (7, 0.5)])
def test_nearest_k_against_all_pairs(spark, monkeypatch, k, km):
    monkeypatch.setattr("civiclake.operators.nearest_join.LEAF", 4)
    r = random.Random(k)
    targets = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(120)] + [(1000 + i, 20 + r.gauss(0, 1e-3), 10 + r.gauss(0, 1e-3)) for i in range(200)]
    targets += [(2000 + i, 5.0, 5.0) for i in range(30)] + [(3000 + i, float(i % 5), float(i // 5)) for i in range(25)] + [(4000, None, 1.0), (4001, 1.0, None)]
    probes = [(i, r.uniform(-200, 200), r.uniform(-95, 95)) for i in range(25)] + [(100 + i, 20.0 + r.gauss(0, 0.01), 10.0) for i in range(15)]
    probes += [(200, 2.0, 2.0), (201, 5.0, 5.0), (202, None, 3.0), (203, 2.5, 2.5), (203, 2.5, 2.5), (1, 0.0, 0.0)]
    asked = spark.createDataFrame([(p, x, y, 9) for p, x, y in probes], "probe long, lon double, lat double, cx int")
    there = spark.createDataFrame([(t, x, y, "z") for t, x, y in targets], "target int, lon double, lat double, n string")
    got = nearest_k_join(asked, there, k, "probe", "target", within_km=km).withColumn("distance_km", F.round("distance_km", 6))
    assert {tuple(x) for x in got.collect()} == near_by_hand(probes, targets, k, km)


def test_nearest_k_of_nothing(spark):
    asked = spark.createDataFrame([(1, 0.0, 0.0)], "probe long, lon double, lat double")
    there = asked.withColumnRenamed("probe", "target")
    assert nearest_k_join(asked, there.limit(0), 3, "probe", "target").count() == 0
    assert nearest_k_join(asked.limit(0), there, 3, "probe", "target").count() == 0
    assert [tuple(x) for x in nearest_k_join(asked, there, 3, "probe", "target").collect()] == [(1, 1, 1, 0.0)]
    with pytest.raises(ValueError):
        nearest_k_join(asked, there, 0, "probe", "target")


def test_cells_of_probes_and_not_probes_go_down(spark, monkeypatch, tmp_path):
    """Probes far from all targets and close to each other: what is written per level does not grow with them."""
    monkeypatch.setattr("civiclake.operators.nearest_join.work_dir", lambda spark, purpose: f"{tmp_path}/work")
    r = random.Random(3)
    probes = [(i, 40 + r.random() / 1000, -0.0 if i % 7 == 0 else 30 + r.random() / 1000) for i in range(700)]
    targets = [(i, r.gauss(0, 2), r.gauss(0, 2)) for i in range(400)] + [(1000 + i, 1.0, 1.0) for i in range(30)] + [(None, 40.0, 30.0)]
    given = [spark.createDataFrame(x, "id int, lon double, lat double") for x in (probes, targets)]
    found = nearest_k_join(given[0].withColumnRenamed("id", "p"), given[1].withColumnRenamed("id", "t"), 3, "p", "t")
    assert {(x["p"], x["rank"], x["t"], round(x["distance_km"], 6)) for x in found.collect()} == near_by_hand(probes, targets[:-1], 3)
    fronts = [spark.read.parquet(str(x)).count() for x in (tmp_path / "work").glob("front-*")]
    assert fronts and max(fronts) < 5_000


@pytest.mark.parametrize("km", [None, 150.0])
def test_places_and_texts_that_repeat_are_joined_once(spark, monkeypatch, km):
    """Every pair of rows is there, also of rows that are equal and of places with more rows than a list holds."""
    monkeypatch.setattr("civiclake.operators.spatial.MOST_TOGETHER", 3)
    r = random.Random(9)
    points = [(i, r.choice([1.0, 2.5, -0.0, 0.0, 3.0]), r.choice([1, 2, 5])) for i in range(60)] + [(1, 1.0, 1)] * 8 + [(99, None, 1), (98, float("nan"), 2)]
    shapes = [(i % 9, r.choice([HOLE, CONCAVE, TWO, LINE, "POINT (1 1)", "POLYGON EMPTY", None])) for i in range(50)] + [(3, HOLE)] * 7
    left, right = spark.createDataFrame(points, "p int, lon double, lat long"), spark.createDataFrame(shapes, "s int, geometry_wkt string")
    shape, x, y = g.parse_wkt(F.col("geometry_wkt")), F.col("lon"), F.col("lat").cast("double")
    both = left.where("lon is not null and not isnan(lon)").crossJoin(right.where("geometry_wkt is not null"))
    want = both.where(g.contains_point(shape, x, y) if km is None else g.distance(shape, x, y) <= km / 111.0)
    got = spatial_join(left, right, within_km=km)
    assert got.columns == ["p", "lon", "lat", "s", "geometry_wkt", *(["distance_km"] if km else [])]
    key = lambda row: (row["p"], str(row["lon"]), row["lat"], row["s"], row["geometry_wkt"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() > 100


def test_rounded_is_round(spark):
    r = random.Random(4)
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, 0.0000005, -0.0000015, 1e-9, -1e-9, 123.4567895, 99999.9999995, 1e5, 1e9, 1e15, 1e300, float("nan"), float("inf"), None]
    values += [r.uniform(0, 200) for _ in range(3_000)] + [r.uniform(-1, 1) * 10 ** r.uniform(-8, 12) for _ in range(3_000)]
    values += [round(r.uniform(0, 300), 6) + 0.5e-6 for _ in range(1_000)] + [k / 2e6 for k in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 2, 6):
        wrong = df.select("v", g.rounded(F.col("v"), n).alias("got"), F.round("v", n).alias("want")).where("cast(got as string) is distinct from cast(want as string)")
        assert wrong.collect() == []


SHAPES = [
    HOLE, CONCAVE, TWO, LINE, LOOP, MIXED, "POINT (3 4)", "MULTIPOINT ((1 1), (4 2))", "POLYGON EMPTY", "LINESTRING (2 2, 2 2)", "LINESTRING (0 0, 0 0, 3 1)", "LINESTRING (1 2)",
    "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "GEOMETRYCOLLECTION (POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0)), LINESTRING (5 5, 6 6))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2)))", "POLYGON Z ((0 0 1, 4 0 1, 4 3 1, 0 0 1))",
]


def test_outlines_are_as_far_as_parsed_geometries(spark):
    """Every distance, to the last bit, also of geometries too long or too mixed for an outline."""
    r = random.Random(12)
    texts = [(i, w) for i, w in enumerate(SHAPES)] + [(100 + i, ring(r, r.uniform(-3, 8), r.uniform(-3, 8), 10 ** r.uniform(-2, 0.8), r.randint(3, 14))) for i in range(60)]
    spots = [(i, r.uniform(-4, 9), r.uniform(-4, 9)) for i in range(150)] + [(500 + 20 * i + j, i * 1.0, j * 0.5) for i in range(7) for j in range(13)]
    left = spark.createDataFrame(spots, "p int, lon double, lat double")
    right = spark.createDataFrame(texts, "s int, geometry_wkt string")
    shape = g.parse_wkt(F.col("geometry_wkt"))
    few = right.select(F.count_if(g.outline(shape).isNotNull()).alias("few"), F.count("s").alias("all")).first()
    assert 20 < few["few"] < few["all"] - 20
    away = g.distance(shape, F.col("lon"), F.col("lat"))
    both = left.crossJoin(right).where(away <= 200 / 111.0)
    for decimals in (None, 6):
        km = away * g.KM_PER_DEGREE
        want = both.select("p", "s", (km if decimals is None else F.round(km, decimals)).alias("d"))
        got = spatial_join(left, right, within_km=200, decimals=decimals).select("p", "s", "distance_km")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 2_000


def test_pairs_are_spelled_out_a_list_at_a_time(spark):
    """A compiled generator holds all rows of an input row: of the two that spell out pairs only the last is compiled."""
    left = spark.range(3_000).selectExpr("id p", "1.0D lon", "1.0D lat")
    right = spark.range(900).selectExpr("id s", f"'{HOLE}' geometry_wkt")
    found = spatial_join(left, right, within_km=200, decimals=6).select("p", "s", "distance_km")
    assert found.agg(F.count("p"), F.countDistinct("p", "s")).first() == (2_700_000, 2_700_000)
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    spelled = [x for x in plan if "Generate explode(transform(" in x]
    assert spelled and not any("*(" in x for x in spelled)
    # The test by outline is not part of the join's one method, which would be too long to be compiled.
    tests = [x for x in plan if "AS _square#" in x]
    assert tests and not any("*(" in x for x in tests)


def test_tables_of_one_column_and_columns_of_other_case(spark):
    left = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "lon double, lat double")
    one = spark.createDataFrame([("POINT (1 1)",)] * 3, "geometry_wkt string")
    assert [tuple(x) for x in spatial_join(left, one, within_km=1).collect()] == [(1.0, 1.0, "POINT (1 1)", 0.0)] * 6
    other = spark.createDataFrame([(7, "POINT (1 1)"), (8, "POINT (1 1)")], "`s.t` int, Geometry_WKT string")
    got = spatial_join(left, other)
    assert got.columns == ["lon", "lat", "s.t", "Geometry_WKT"] and sorted(x[2] for x in got.collect()) == [7, 7, 8, 8]
