"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.functions import geometry as g
from civiclake.operators import spatial as sp
from civiclake.operators.cover import count_in_shapes
from civiclake.operators.nearest_join import nearest_k_join
from civiclake.plans.fixtures import GEO_POINTS, GEO_POLYS, geo_points, geo_polys
from civiclake.plans.suite import Suite

PLACES = Suite()

# Distance from a point to an axis-parallel rectangle, by arithmetic.
RECT = "sqrt(pow(greatest(x0 - ({x}), ({x}) - x1, 0), 2) + pow(greatest(y0 - ({y}), ({y}) - y1, 0), 2))"


def rect(x, y):
    return RECT.replace("{x}", str(x)).replace("{y}", str(y))


@PLACES.query("contains_point", f"""
SELECT id, x0, y0, x1, y1, 0.0::DOUBLE AS distance FROM {GEO_POLYS} WHERE x0 < -156.5 AND x1 > -156.5 AND y0 < -79 AND y1 > -79""")
def contains_point(t):
    return sp.contains_point(geo_polys(t), -156.5, -79, limit=None).drop("geometry_wkt")


@PLACES.query("within_radius", f"""
SELECT id, ROUND({rect(10, 20)} * 111.0::DOUBLE, 6) AS distance_km FROM {GEO_POLYS} WHERE {rect(10, 20)} <= 2000 / 111.0::DOUBLE ORDER BY distance_km""")
def within_radius(t):
    return sp.within_radius(geo_polys(t), 10, 20, 2000, limit=None).select("id", F.round("distance_km", 6).alias("distance_km"))


@PLACES.query("nearest_k", f"""
SELECT id, ROUND(sqrt(pow(lon - 3, 2) + pow(lat + 7, 2)) * 111.0::DOUBLE, 6) AS distance_km FROM {GEO_POINTS}
WHERE geometry_wkt IS NOT NULL AND sqrt(pow(lon - 3, 2) + pow(lat + 7, 2)) <= 3000 / 111.0::DOUBLE ORDER BY distance_km, id LIMIT 15""")
def nearest_k(t):
    return sp.within_radius(geo_points(t), 3, -7, 3000, limit=15, tie=["id"]).select("id", F.round("distance_km", 6).alias("distance_km"))


@PLACES.query("within_bbox", f"""
SELECT 'point' AS kind, id FROM {GEO_POINTS} WHERE geometry_wkt IS NOT NULL AND lon BETWEEN -20 AND 30 AND lat BETWEEN 10 AND 45
UNION ALL SELECT 'rectangle', id FROM {GEO_POLYS} WHERE x0 <= 30 AND x1 >= -20 AND y0 <= 45 AND y1 >= 10""")
def within_bbox(t):
    box = [-20, 10, 30, 45]
    return sp.within_bbox(geo_points(t), box, limit=None).select(F.lit("point").alias("kind"), "id").unionByName(
        sp.within_bbox(sp.with_bounds(geo_polys(t)), box, limit=None).select(F.lit("rectangle").alias("kind"), "id"))


@PLACES.query("valid_probes", """
SELECT c_custkey, CASE WHEN abs(c_acctbal / 100) > 90 THEN 'latitude' WHEN abs(c_custkey % 400 - 200) > 180 THEN 'longitude' WHEN c_nationkey - 3 <= 0 THEN 'radius' END AS problem FROM customer""")
def valid_probes(t):
    return sp.valid_probes(t.customer.select(
        "c_custkey", (F.col("c_custkey") % 400 - 200).alias("lon"), (F.col("c_acctbal") / 100).alias("lat"),
        (F.col("c_nationkey") - 3).alias("km"))).select("c_custkey", "problem")


@PLACES.query("geo_feature_count", f"SELECT COUNT(geometry_wkt) AS features FROM {GEO_POINTS}")
def geo_feature_count(t):
    return sp.geo_feature_count(geo_points(t))


BOTH = f"(SELECT id, lon AS x0, lat AS y0, lon AS x1, lat AS y1, geometry_wkt, 'Point' AS kind FROM {GEO_POINTS} UNION ALL SELECT *, 'Polygon' FROM {GEO_POLYS})"


def both(t):
    return geo_points(t).select("id", "geometry_wkt").unionByName(geo_polys(t).select("id", "geometry_wkt"))


@PLACES.query("geo_bounds", f"""
SELECT COUNT(*) AS row_count, CAST(MIN(x0) AS DOUBLE) AS minx, CAST(MIN(y0) AS DOUBLE) AS miny, CAST(MAX(x1) AS DOUBLE) AS maxx, CAST(MAX(y1) AS DOUBLE) AS maxy
FROM {BOTH}""".replace("MIN(x0)", "MIN(CASE WHEN geometry_wkt IS NOT NULL THEN x0 END)").replace("MIN(y0)", "MIN(CASE WHEN geometry_wkt IS NOT NULL THEN y0 END)")
    .replace("MAX(x1)", "MAX(CASE WHEN geometry_wkt IS NOT NULL THEN x1 END)").replace("MAX(y1)", "MAX(CASE WHEN geometry_wkt IS NOT NULL THEN y1 END)"))
def geo_bounds(t):
    return sp.geo_summary(both(t)).drop("geometry_types")


@PLACES.query("geo_types", f"SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) AS geometry_types FROM {BOTH} WHERE geometry_wkt IS NOT NULL")
def geo_types(t):
    return sp.geo_summary(both(t)).select(F.array_join("geometry_types", ",").alias("geometry_types"))


@PLACES.query("wkt_bounds", f"""
SELECT id, kind AS geometry_type, CAST(x0 AS DOUBLE) AS minx, CAST(y0 AS DOUBLE) AS miny, CAST(x1 AS DOUBLE) AS maxx, CAST(y1 AS DOUBLE) AS maxy FROM {BOTH} WHERE geometry_wkt IS NOT NULL""")
def wkt_bounds(t):
    return sp.with_bounds(both(t).where(F.col("geometry_wkt").isNotNull())).drop("geometry_wkt")


@PLACES.query("wkt_shapes", """
WITH d AS (SELECT o_orderkey, o_orderkey % 50 AS x, o_custkey % 40 AS y, o_orderkey % 4 AS kind FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN x > 0 AND x < 40 AND y > 0 AND y < 30 AND NOT (x >= 10 AND x <= 20 AND y >= 10 AND y <= 20)
 WHEN 1 THEN (x > 0 AND x < 8 AND y > 0 AND y < 8) OR (x > 30 AND x < 45 AND y > 20 AND y < 35)
 WHEN 2 THEN y = 5 AND x > 0 AND x < 40 ELSE (x = 7 AND y = 3) OR (x = 11 AND y = 31) END AS inside FROM d""")
def wkt_shapes(t):
    """Order keys as points against a polygon with a hole, two polygons, a line and two points."""
    shapes = F.array(
        F.lit("POLYGON ((0 0, 40 0, 40 30, 0 30, 0 0), (10 10, 20 10, 20 20, 10 20, 10 10))"),
        F.lit("MULTIPOLYGON (((0 0, 8 0, 8 8, 0 8, 0 0)), ((30 20, 45 20, 45 35, 30 35, 30 20)))"),
        F.lit("LINESTRING (0 5, 40 5)"), F.lit("MULTIPOINT ((7 3), (11 31))"))
    key = F.col("o_orderkey")
    x, y = (key % 50).cast("double"), (F.col("o_custkey") % 40).cast("double")
    return t.orders.select("o_orderkey", F.element_at(shapes, (key % 4 + 1).cast("int")).alias("wkt"), x.alias("x"), y.alias("y")).select(
        "o_orderkey", g.contains_point(g.parse_wkt(F.col("wkt")), F.col("x"), F.col("y")).alias("inside"))


@PLACES.query("point_in_polygon_join", f"""
SELECT p.id AS point_id, r.id AS poly_id FROM {GEO_POINTS} p JOIN {GEO_POLYS} r ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1""")
def point_in_polygon_join(t):
    points = geo_points(t).select(F.col("id").alias("point_id"), "lon", "lat")
    polys = geo_polys(t).select(F.col("id").alias("poly_id"), "geometry_wkt")
    return sp.spatial_join(points, polys).select("point_id", "poly_id")


@PLACES.query("radius_join", f"""
SELECT p.id AS point_id, r.id AS poly_id, ROUND({rect('p.lon', 'p.lat')} * 111.0::DOUBLE, 6) AS distance_km
FROM {GEO_POINTS} p JOIN {GEO_POLYS} r ON {rect('p.lon', 'p.lat')} <= 200 / 111.0::DOUBLE""")
def radius_join(t):
    points = geo_points(t).select(F.col("id").alias("point_id"), "lon", "lat")
    polys = geo_polys(t).select(F.col("id").alias("poly_id"), "geometry_wkt")
    return sp.spatial_join(points, polys, within_km=200, decimals=6).select("point_id", "poly_id", "distance_km")


@PLACES.query("count_in_shapes", f"""
SELECT r.id AS poly_id, COUNT(p.id) AS points FROM {GEO_POLYS} r LEFT JOIN {GEO_POINTS} p ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY r.id""")
def counted_in_shapes(t):
    """Points per shape by quadtree cover: a row per shape, however many points there are."""
    return count_in_shapes(geo_points(t).select("lon", "lat"), geo_polys(t).select(F.col("id").alias("poly_id"), "geometry_wkt"), "poly_id")


@PLACES.query("nearest_k_join", f"""
SELECT probe_id, CAST(rank AS INTEGER) AS rank, target_id, ROUND(d * 111.0::DOUBLE, 6) AS distance_km FROM (
 SELECT p.id AS probe_id, r.id AS target_id, sqrt(pow(r.x0 - p.lon, 2) + pow(r.y0 - p.lat, 2)) AS d,
 row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(r.x0 - p.lon, 2) + pow(r.y0 - p.lat, 2)), r.id) AS rank
 FROM {GEO_POINTS} p CROSS JOIN {GEO_POLYS} r) WHERE rank <= 5""")
def nearest_joined(t):
    """The five nearest rectangle corners of every customer's point."""
    probes = geo_points(t).select(F.col("id").alias("probe_id"), "lon", "lat")
    targets = geo_polys(t).select(F.col("id").alias("target_id"), F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    return nearest_k_join(probes, targets, 5, "probe_id", "target_id").withColumn("distance_km", F.round("distance_km", 6))


@PLACES.query("nearest_k_within", f"""
SELECT probe_id, CAST(rank AS INTEGER) AS rank, target_id, ROUND(d * 111.0::DOUBLE, 6) AS distance_km FROM (
 SELECT p.id AS probe_id, r.id AS target_id, sqrt(pow(r.x0 - p.lon, 2) + pow(r.y0 - p.lat, 2)) AS d,
 row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(r.x0 - p.lon, 2) + pow(r.y0 - p.lat, 2)), r.id) AS rank
 FROM {GEO_POINTS} p CROSS JOIN {GEO_POLYS} r WHERE sqrt(pow(r.x0 - p.lon, 2) + pow(r.y0 - p.lat, 2)) <= 555 / 111.0::DOUBLE) WHERE rank <= 5""")
def nearest_within(t):
    """The same within 555 km: many points have fewer than five."""
    probes = geo_points(t).select(F.col("id").alias("probe_id"), "lon", "lat")
    targets = geo_polys(t).select(F.col("id").alias("target_id"), F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    return nearest_k_join(probes, targets, 5, "probe_id", "target_id", within_km=555).withColumn("distance_km", F.round("distance_km", 6))
