"""Column expressions on geometry text (WKT), in planar degrees.

A parsed geometry is an array of components ``struct<kind, points, ends, segments>``:
kind is point, line or area, points are all vertices, ends the first and last vertex
of every ring or line, segments the pieces between neighbours. A collection gives
several components, any other geometry one, an empty one none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0

def geometry_type(wkt: Column) -> Column:
    """``Point``, ``MultiPolygon`` and so on."""
    word = F.upper(F.regexp_extract(wkt, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))
    names = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
    return F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n.upper(), n)]), word)


def parse_wkt(wkt: Column) -> Column:
    """The components of a geometry; NULL for NULL."""
    def point(text: Column) -> Column:
        numbers = F.split(F.btrim(text, F.lit(" \t\r\n")), r"\s+")
        return F.struct(F.get(numbers, F.lit(0)).cast("double").alias("x"), F.get(numbers, F.lit(1)).cast("double").alias("y"))

    def rings(member: Column) -> Column:
        body = F.btrim(F.substr(member, F.instr(member, "(")), F.lit("() \t\r\n"))
        return F.transform(F.split(body, r"\)[\s,()]*\("), lambda ring: F.transform(F.split(ring, ","), point))

    def kind(member: Column) -> Column:
        name = F.upper(member)
        return F.when(name.contains("POLYGON"), "area").when(name.contains("LINESTRING"), "line").otherwise("point")

    # A member of a collection starts with a word; coordinates never do.
    inner = F.regexp_replace(wkt, r"(?i)GEOMETRYCOLLECTION\s*(?:ZM|Z|M)?\s*\(", "")
    members = (
        F.when(F.upper(wkt).contains("COLLECTION"), F.filter(F.split(inner, r",\s*(?=[A-Za-z])"), lambda m: m.contains("(")))
        .when(wkt.contains("("), F.array(wkt))
        .when(wkt.isNotNull(), F.array().cast("array<string>"))
    )
    return F.transform(members, lambda m: F.get(F.transform(F.array(rings(m)), lambda r: F.struct(
        kind(m).alias("kind"), F.flatten(r).alias("points"), _ends(r).alias("ends"), _segments(r).alias("segments"))), F.lit(0)))


def _ends(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda r: F.array(F.get(r, F.lit(0)), F.element_at(r, -1))))


def _segments(rings: Column) -> Column:
    def of_ring(ring: Column) -> Column:
        n = F.size(ring) - 1
        return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(rings, of_ring))


def vertices(geometry: Column) -> Column:
    return F.flatten(F.transform(geometry, lambda c: c["points"]))


def bounds(geometry: Column) -> Column:
    """``struct<minx, miny, maxx, maxy>``; NULL fields if there is no vertex."""
    def edge(best, axis: str) -> Column:
        return best(F.transform(geometry, lambda c: best(F.transform(c["points"], lambda p: p[axis]))))

    return F.struct(
        edge(F.array_min, "x").alias("minx"), edge(F.array_min, "y").alias("miny"),
        edge(F.array_max, "x").alias("maxx"), edge(F.array_max, "y").alias("maxy"))


def side(s: Column, x: Column, y: Column) -> Column:
    """Positive left of the segment, negative right of it, zero on its line."""
    return (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])


def on_segment(s: Column, x: Column, y: Column) -> Column:
    return (
        (side(s, x, y) == 0)
        & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
        & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
    )


def _on_edge(component: Column, x: Column, y: Column) -> Column:
    return F.exists(component["segments"], lambda s: on_segment(s, x, y))


def _crossed(s: Column, x: Column, y: Column) -> Column:
    return ((s["y1"] > y) != (s["y2"] > y)) & (
        ((s["y2"] > s["y1"]) & (side(s, x, y) > 0)) | ((s["y2"] < s["y1"]) & (side(s, x, y) < 0)))


def _encloses(component: Column, x: Column, y: Column) -> Column:
    """True if a ray from the point crosses the rings an odd number of times."""
    return F.size(F.filter(component["segments"], lambda s: _crossed(s, x, y))) % 2 == 1


def contains_point(geometry: Column, x: Column, y: Column) -> Column:
    """True if the point lies in the interior: edges of areas and ends of lines do not count."""
    def same(p: Column) -> Column:
        return (p["x"] == x) & (p["y"] == y)

    return F.exists(geometry, lambda c: (
        F.when(c["kind"] == "area", _encloses(c, x, y) & ~_on_edge(c, x, y))
        .when(c["kind"] == "line", _on_edge(c, x, y) & (F.size(F.filter(c["ends"], same)) % 2 == 0))
        .otherwise(F.exists(c["points"], same))
    ))


def _segment_square(s: Column, x: Column, y: Column) -> Column:
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    along = F.coalesce(F.try_divide((x - s["x1"]) * dx + (y - s["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    gx, gy = x - (s["x1"] + share * dx), y - (s["y1"] + share * dy)
    return gx * gx + gy * gy


def distance(geometry: Column, x: Column, y: Column) -> Column:
    """Planar distance to a point: 0 inside an area, NULL for an empty geometry."""
    def to_points(c: Column) -> Column:
        return F.array_min(F.transform(
            c["points"], lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))))

    def to_segments(c: Column) -> Column:
        return F.array_min(F.transform(c["segments"], lambda s: F.sqrt(_segment_square(s, x, y))))

    return F.array_min(F.transform(geometry, lambda c: (
        F.when(c["kind"] == "point", to_points(c))
        .when((c["kind"] == "area") & _encloses(c, x, y), 0.0)
        .otherwise(F.coalesce(to_segments(c), to_points(c)))
    )))


# Geometries of at most so many segments are tested by compiled code; functions over arrays are interpreted, some fifty times slower.
FEW = 8


def outline(geometry: Column) -> Column:
    """The corners of all segments, x1, y1, x2, y2 each, of a line or area of at most ``FEW``; NULL for any other geometry."""
    c = F.get(geometry, F.lit(0))
    segments = c["segments"]
    numbers = F.flatten(F.transform(segments, lambda s: F.array(*[s[n] for n in ("x1", "y1", "x2", "y2")])))
    simple = (F.size(geometry) == 1) & (c["kind"] != "point") & F.size(segments).between(1, FEW) & ~F.exists(numbers, F.isnull)
    return F.when(simple, numbers)


def outline_square(numbers: Column, x: Column, y: Column) -> Column:
    """Square of the distance to the segments of an ``outline``."""
    return F.least(*[_segment_square(s, x, y) for s in _of_outline(numbers)])


def outline_encloses(numbers: Column, x: Column, y: Column) -> Column:
    return sum([F.when(_crossed(s, x, y), 1).otherwise(0) for s in _of_outline(numbers)], F.lit(0)) % 2 == 1


def _of_outline(numbers: Column) -> list[dict[str, Column]]:
    return [{n: F.get(numbers, F.lit(4 * i + k)) for k, n in enumerate(("x1", "y1", "x2", "y2"))} for i in range(FEW)]


def _segment_meets(s: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    minx, miny, maxx, maxy = box
    overlap = (
        (F.least(s["x1"], s["x2"]) <= maxx) & (F.greatest(s["x1"], s["x2"]) >= minx)
        & (F.least(s["y1"], s["y2"]) <= maxy) & (F.greatest(s["y1"], s["y2"]) >= miny)
    )
    corners = [side(s, cx, cy) for cx in (minx, maxx) for cy in (miny, maxy)]
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _point_in(p: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    minx, miny, maxx, maxy = box
    return p["x"].between(minx, maxx) & p["y"].between(miny, maxy)


def edge_meets_box(geometry: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """True if a point, a line or the edge of an area meets the box; touching counts."""
    return F.exists(geometry, lambda c: F.exists(c["points"], lambda p: _point_in(p, box)) | F.exists(c["segments"], lambda s: _segment_meets(s, box)))


def intersects_box(geometry: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """True if the geometry meets the box; touching counts."""
    return F.exists(geometry, lambda c: (
        F.when(c["kind"] == "point", F.exists(c["points"], lambda p: _point_in(p, box)))
        .otherwise(F.exists(c["segments"], lambda s: _segment_meets(s, box)) | ((c["kind"] == "area") & _encloses(c, box[0], box[1])))
    ))


def rounded(value: Column, decimals: int) -> Column:
    """``F.round`` of a number, without its detour over decimal text unless the number lies near the middle of two results."""
    scale = float(10**decimals)
    scaled = value * scale
    # Below 1e11 the product is off by less than 1e-4; a whole number over a power of ten is the double that the text would give.
    clear = (F.abs(scaled) < 1e11) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.rint(scaled) / scale + 0.0).otherwise(F.round(value, decimals))
