"""Hand-made shapes, and joins against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civiclake.functions import geometry as g
from civiclake.operators import spatial as sp
from civiclake.operators.ranges import range_join

HOLE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
CONCAVE = "POLYGON ((0 0, 10 0, 10 10, 5 2, 0 10, 0 0))"
TWO = "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 7 6, 7 7, 6 7, 6 6)))"
LINE = "LINESTRING (0 0, 4 4, 8 0)"
LOOP = "LINESTRING (0 0, 4 0, 4 4, 0 0)"
NESTED = "GEOMETRYCOLLECTION (GEOMETRYCOLLECTION (POINT (1 1), POINT EMPTY), MULTIPOINT ((2 2), (3 3)))"
MIXED = "GEOMETRYCOLLECTION (POINT (50 50), LINESTRING (20 0, 30 0), POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0)))"


INSIDE = [
    (HOLE, 1, 1, True), (HOLE, 5, 5, False), (HOLE, 4, 5, False), (HOLE, 0, 5, False), (HOLE, 0, 0, False), (HOLE, 11, 5, False), (HOLE, 2, 4, True),
    (CONCAVE, 5, 1, True), (CONCAVE, 5, 5, False), (CONCAVE, 1, 5, True), (CONCAVE, 5, 2, False),
    (TWO, 1, 1, True), (TWO, 3, 3, False), (TWO, 8, 8, True), (TWO, 6.5, 6.5, False), (TWO, 6, 6.5, False),
    (LINE, 2, 2, True), (LINE, 0, 0, False), (LINE, 4, 4, True), (LINE, 4, 0, False), (LOOP, 0, 0, True),
    ("POINT (3 4)", 3, 4, True), ("POINT Z (3 4 9)", 3, 4, True), ("POINT (3 4)", 3, 5, False), ("MULTIPOINT ((1 1), (2 2))", 2, 2, True), ("MULTIPOINT (1 1, 2 2)", 2, 2, True),
    (MIXED, 50, 50, True), (MIXED, 25, 0, True), (MIXED, 1, 1, True), (MIXED, 40, 40, False), (NESTED, 1, 1, True), (NESTED, 3, 3, True), (NESTED, 2, 1, False), ("POLYGON EMPTY", 0, 0, False),
    ("polygon((-1e1 -.5,10 -.5,10 +5.,-10 5,-10 -.5))", 0, 0, True),
]


def at_points(spark, cases, make):
    rows = [(i, w, float(x), float(y)) for i, (w, x, y, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, w string, x double, y double")
    out = df.select("i", make(g.parse_wkt(F.col("w")), F.col("x"), F.col("y")).alias("v")).collect()
    return [r["v"] for r in sorted(out)]


def test_contains(spark):
    assert at_points(spark, INSIDE, g.contains_point) == [c[3] for c in INSIDE]


FAR = [
    (HOLE, 1, 1, 0.0), (HOLE, 5, 5, 1.0), (HOLE, 13, 14, 5.0), (HOLE, 10, 3, 0.0), (LINE, 4, 6, 2.0), (LINE, 2, 0, math.sqrt(2)),
    ("POINT (0 0)", 3, 4, 5.0), ("MULTIPOINT ((0 0), (3 3))", 3, 4, 1.0), (TWO, 3, 1, 1.0), (MIXED, 50, 51, 1.0), ("POINT EMPTY", 0, 0, None),
]


def test_distance(spark):
    for got, (_, _, _, far) in zip(at_points(spark, FAR, g.distance), FAR):
        assert got == (None if far is None else pytest.approx(far, abs=1e-12))


MEETS = [
    (HOLE, (1, 1, 2, 2), True), (HOLE, (4.5, 4.5, 5.5, 5.5), False), (HOLE, (-5, -5, 20, 20), True), (HOLE, (10, 10, 12, 12), True), (HOLE, (10.1, 0, 12, 12), False),
    (LINE, (1, 0, 2, 0.5), False), (LINE, (1, 0, 2, 1), True), (LINE, (3, 0, 5, 9), True), ("POINT (1 1)", (1, 1, 2, 2), True), ("POINT (1 1)", (1.1, 1, 2, 2), False),
    (CONCAVE, (4, 6, 6, 9), False), (CONCAVE, (4, 0.5, 6, 1), True),
]


def test_box(spark):
    rows = [(i, w, *map(float, box)) for i, (w, box, _) in enumerate(MEETS)]
    df = spark.createDataFrame(rows, "i int, w string, a double, b double, c double, d double")
    out = df.select("i", g.intersects_box(g.parse_wkt(F.col("w")), tuple(F.col(n) for n in "abcd")).alias("v")).collect()
    assert [r["v"] for r in sorted(out)] == [m for _, _, m in MEETS]


def test_types_and_bounds(spark):
    df = spark.createDataFrame([(HOLE,), (TWO,), (MIXED,), (None,), ("POINT EMPTY",)], "geometry_wkt string")
    got = [tuple(r)[1:] for r in sp.with_bounds(df).collect()]
    assert got == [("Polygon", 0, 0, 10, 10), ("MultiPolygon", 0, 0, 9, 9), ("GeometryCollection", 0, 0, 50, 50),
                   (None, None, None, None, None), ("Point", None, None, None, None)]
    summary = sp.geo_summary(df).first()
    assert (summary["row_count"], summary["maxx"], summary["geometry_types"]) == (5, 50, ["GeometryCollection", "MultiPolygon", "Point", "Polygon"])


def test_arguments(spark):
    df = spark.createDataFrame([("POINT (1 2)",)], "geometry_wkt string")
    for call, code, value in [
        (lambda: sp.contains_point(df, -79.0, 9999), "latitude", 9999), (lambda: sp.contains_point(df, 999, 43.0), "longitude", 999),
        (lambda: sp.within_radius(df, -79.0, 43.0, -5), "radius", -5), (lambda: sp.within_bbox(df, [1, 2, 3]), "box", (1, 2, 3)),
        (lambda: sp.within_bbox(df, [0, 0, 200, 1]), "longitude", 200), (lambda: sp.within_bbox(df, [0, -100, 20, 1]), "latitude", -100),
        (lambda: sp.contains_point(df, float("nan"), 0.0), "longitude", None),
    ]:
        with pytest.raises(sp.BadArgument) as caught:
            call()
        assert caught.value.code == code and (value is None or caught.value.value == value)


def test_radius_order_and_limit(spark):
    df = spark.createDataFrame([(i, f"POINT ({i} 0)") for i in range(6)] + [(9, None)], "id int, geometry_wkt string")
    got = sp.within_radius(df, 2, 0, 250, limit=3, tie=["id"]).collect()
    assert [(r["id"], r["distance_km"]) for r in got] == [(2, 0.0), (1, 111.0), (3, 111.0)]
    km = sp.within_radius(df, 2, 0, 120, great_circle=True).where("id = 1").first()["distance_km"]
    assert km == pytest.approx(111.195, abs=0.01)


def test_great_circle_filters_and_sorts_by_one_length(spark):
    rnd = random.Random(8)
    places = [(i, rnd.uniform(-180, 180), rnd.uniform(-89, 89)) for i in range(400)] + [(400 + i, rnd.uniform(-2, 2) + 178, 70 + rnd.uniform(-3, 3)) for i in range(50)]
    df = sp.with_bounds(spark.createDataFrame([(i, f"POINT ({x!r} {y!r})") for i, x, y in places], "id int, geometry_wkt string"))

    def length(x, y, lon, lat):
        h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        return 2 * sp.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    for lon, lat, km in ((179.0, 70.0, 300.0), (0.0, 60.0, 2500.0), (10.0, 89.0, 1500.0), (-40.0, -5.0, 4000.0)):
        got = [(r["id"], r["distance_km"]) for r in sp.within_radius(df, lon, lat, km, great_circle=True, tie=["id"]).collect()]
        want = sorted((length(x, y, lon, lat), i) for i, x, y in places if length(x, y, lon, lat) <= km)
        assert [i for i, _ in got] == [i for _, i in want]
        assert [d for _, d in got] == pytest.approx([d for d, _ in want])
    area = spark.createDataFrame([(1, HOLE), (2, None), (3, "POINT EMPTY")], "id int, geometry_wkt string")
    assert [tuple(r)[::2] for r in sp.within_radius(area, 1, 1, 1, great_circle=True).collect()] == [(1, 0.0)]


def test_spatial_join_against_all_pairs(spark):
    rnd = random.Random(5)
    boxes = []
    for i in range(120):
        w, h = 10 ** rnd.uniform(-3, 2), 10 ** rnd.uniform(-3, 1.5)
        x, y = (rnd.uniform(-170, 60), rnd.uniform(-80, 40)) if i % 3 else (20.0, 10.0)
        boxes.append((i, x, y, x + w, y + h))
    points = [(i, *((20.0 + rnd.random() / 50, 10.0 + rnd.random() / 50) if i % 3 == 0 else (rnd.uniform(-180, 180), rnd.uniform(-90, 90)))) for i in range(600)]
    shapes = spark.createDataFrame(
        [(i, f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))") for i, a, b, c, d in boxes] + [(-1, None), (-2, "POLYGON EMPTY")], "poly int, geometry_wkt string")
    probes = spark.createDataFrame(points, "point int, lon double, lat double")
    got = sorted((r["point"], r["poly"]) for r in sp.spatial_join(probes, shapes).collect())
    want = sorted((p, i) for p, x, y in points for i, a, b, c, d in boxes if a < x < c and b < y < d)
    assert got == want and len(want) > 500
    km = 300
    got = sorted((r["point"], r["poly"]) for r in sp.spatial_join(probes, sp.with_bounds(shapes), within_km=km).collect())
    want = sorted((p, i) for p, x, y in points for i, a, b, c, d in boxes if math.hypot(max(a - x, x - c, 0), max(b - y, y - d, 0)) <= km / 111)
    assert got == want


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    from civiclake.operators import ranges

    points = spark.range(50).selectExpr("id point", "id * 1.0 lon", "0.5 lat")
    shapes = spark.range(50).selectExpr("id poly", "concat('POLYGON ((', id, ' 0, ', id + 2, ' 0, ', id + 2, ' 2, ', id, ' 2, ', id, ' 0))') geometry_wkt")
    small = sorted(map(tuple, sp.spatial_join(points, shapes).select("point", "poly").collect()))
    monkeypatch.setattr(ranges, "BROADCAST_SOURCE_BYTES", 0)
    large = sp.spatial_join(points, shapes).select("point", "poly")
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, large.collect())) == small == sorted((p, p - 1) for p in range(1, 50))


def test_range_join_against_all_pairs(spark):
    rnd = random.Random(9)
    ranges = [(i, lo, lo + 10 ** rnd.uniform(-2, 5)) for i, lo in enumerate(rnd.uniform(-1000, 1000) for _ in range(150))] + [(900, 5.0, 4.0), (901, 3.0, 3.0)]
    points = [(i, 3.0 if i % 3 == 0 else rnd.uniform(-1500, 1500)) for i in range(400)] + [(999, None)]
    left = spark.createDataFrame(points, "p int, v double")
    right = spark.createDataFrame(ranges, "r int, lo double, hi double")
    got = sorted((r["p"], r["r"]) for r in range_join(left, right, "v", "lo", "hi", width=1.0).collect())
    assert got == sorted((p, r) for p, v in points if v is not None for r, lo, hi in ranges if lo <= v <= hi)


def test_spatial_searches_give_all_rows_and_a_fixed_first_part(spark):
    df = spark.range(150).selectExpr("id", "'POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))' AS geometry_wkt")
    for search in (lambda d, **x: sp.contains_point(d, 1, 1, **x), lambda d, **x: sp.within_radius(d, 1, 1, 50, **x), lambda d, **x: sp.within_bbox(d, [0, 0, 1, 1], **x)):
        assert search(df).count() == 150
        parts = [{r["id"] for r in search(d, limit=5).collect()} for d in (df, df.orderBy(F.desc("id")))]
        assert parts[0] == parts[1] and len(parts[0]) == 5
