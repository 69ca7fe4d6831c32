"""Spatial filters and joins on tables with geometry text.

A table may carry ``minx, miny, maxx, maxy`` columns, as geographic landings do; the
box test on them then reaches the Parquet scan before any text is parsed. Without
them the box comes from the text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from civiclake.functions import geometry as g
from civiclake.operators.ranges import cell, grid_level, join_by_size, size_of

BOX = ("minx", "miny", "maxx", "maxy")

# Points at one place, or geometries of one text, that go through the join as one row.
MOST_TOGETHER = 2_000

# Cell sizes in degrees that geometries are sorted into by their own extent.
CELL_SIZES = tuple(0.01 * 4**k for k in range(9))


class BadArgument(ValueError):
    """A value that no answer can be given for. ``code`` is ``latitude``, ``longitude``, ``radius`` or ``box``."""

    def __init__(self, code: str, value: object):
        super().__init__(f"{code}: {value!r}")
        self.code, self.value = code, value


def check_point(lon: float, lat: float) -> None:
    for code, value, most in (("latitude", lat, 90), ("longitude", lon, 180)):
        if not abs(value) <= most:
            raise BadArgument(code, value)


def check_radius(km: float) -> None:
    if not km > 0:
        raise BadArgument("radius", km)


def check_box(box: Sequence[float]) -> None:
    """Four values: the least longitude and latitude, then the greatest."""
    if len(box) != 4:
        raise BadArgument("box", tuple(box))
    check_point(*box[:2])
    check_point(*box[2:])


def with_bounds(df: DataFrame, wkt: str = "geometry_wkt") -> DataFrame:
    """Add type and box columns, as they are stored with a geographic landing."""
    return df.withColumn("_box", g.bounds(g.parse_wkt(F.col(wkt)))).select(
        *df.columns, g.geometry_type(F.col(wkt)).alias("geometry_type"), *[F.col(f"_box.{n}").alias(n) for n in BOX]).drop("_box")


def _near(df: DataFrame, box: Sequence[float], wkt: str) -> DataFrame:
    """Rows with a geometry whose stored box, if there is one, meets ``box``."""
    rows = df.where(F.col(wkt).isNotNull())
    if set(BOX) <= set(df.columns):
        rows = rows.where(
            (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
    return rows


def keep_within(df: DataFrame, degrees: Column, reach: float) -> DataFrame:
    """Rows no farther than ``reach``, with ``_degrees``.

    The distance is a generator of one value or none: it is worked out once per row,
    where a filter on a column would work it out again for the result.
    """
    return df.withColumn("_degrees", F.explode(F.filter(F.array(degrees), lambda d: d <= reach)))


def _first(found: DataFrame, limit: int | None, *by: str) -> DataFrame:
    """The first ``limit`` rows by the given columns, then by the whole row, so every run gives the same ones."""
    if limit is None:
        return found
    return found.orderBy(*by, F.to_json(F.struct(*[F.col(f"`{c}`") for c in found.columns]))).limit(limit)


def contains_point(df: DataFrame, lon: float, lat: float, limit: int | None = None, wkt: str = "geometry_wkt") -> DataFrame:
    """Geometries whose interior holds the point, with their planar ``distance``."""
    check_point(lon, lat)
    x, y = F.lit(float(lon)), F.lit(float(lat))
    found = _near(df, (lon, lat, lon, lat), wkt).where(g.contains_point(g.parse_wkt(F.col(wkt)), x, y))
    found = found.withColumn("distance", g.distance(g.parse_wkt(F.col(wkt)), x, y))
    return _first(found, limit)


def within_radius(
    df: DataFrame, lon: float, lat: float, km: float, limit: int | None = None, wkt: str = "geometry_wkt",
    tie: Sequence[str] = (), great_circle: bool = False,
) -> DataFrame:
    """Geometries within ``km``, nearest first, with ``distance_km``.

    Distances are planar, at 111 km per degree. With ``great_circle`` both the filter and the order go by the haversine length
    to the nearest vertex (0 inside an area).
    """
    check_point(lon, lat)
    check_radius(km)
    x, y = F.lit(float(lon)), F.lit(float(lat))
    shape = g.parse_wkt(F.col(wkt))
    if great_circle:
        length = F.array_min(F.transform(g.vertices(shape), lambda p: haversine_km(p, x, y)))
        away = F.when(F.exists(shape, lambda c: c["kind"] == "area") & g.contains_point(shape, x, y), 0.0).otherwise(length)
        found = keep_within(_near(df, _great_circle_box(lon, lat, km), wkt), away, km)
        found = found.withColumnRenamed("_degrees", "distance_km")
    else:
        reach = km / g.KM_PER_DEGREE
        found = keep_within(_near(df, (lon - reach, lat - reach, lon + reach, lat + reach), wkt), g.distance(shape, x, y), reach)
        found = found.withColumn("distance_km", F.col("_degrees") * g.KM_PER_DEGREE).drop("_degrees")
    return found.orderBy("distance_km", *tie) if limit is None else _first(found, limit, "distance_km", *tie)


EARTH_KM = 6371.0088


def _great_circle_box(lon: float, lat: float, km: float) -> tuple[float, float, float, float]:
    """A box that holds all points within ``km``; all longitudes where it would pass a pole or the date line."""
    angle = km / EARTH_KM
    low, high = lat - math.degrees(angle), lat + math.degrees(angle)
    if low <= -90 or high >= 90 or angle >= math.pi / 2:
        return -180.0, low, 180.0, high
    across = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * (1 + 1e-12)
    return (lon - across, low, lon + across, high) if -180 <= lon - across and lon + across <= 180 else (-180.0, low, 180.0, high)


def haversine_km(point: Column, x: Column, y: Column) -> Column:
    lat1, lat2 = F.radians(point["y"]), F.radians(y)
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(x - point["x"]) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * EARTH_KM


def within_bbox(df: DataFrame, box: Sequence[float], limit: int | None = None, wkt: str = "geometry_wkt") -> DataFrame:
    """Geometries that meet the box (min lon, min lat, max lon, max lat); touching counts."""
    check_box(box)
    sides = tuple(F.lit(float(v)) for v in box)
    found = _near(df, box, wkt).where(g.intersects_box(g.parse_wkt(F.col(wkt)), sides))
    return _first(found, limit)


def valid_probes(probes: DataFrame) -> DataFrame:
    """Probe rows (lon, lat, km) with what is wrong with them, or NULL."""
    wrong = (
        F.when(~F.col("lat").between(-90, 90), "latitude").when(~F.col("lon").between(-180, 180), "longitude")
        .when(F.col("km") <= 0, "radius")
    )
    return probes.withColumn("problem", wrong)


def geo_feature_count(df: DataFrame, wkt: str = "geometry_wkt") -> DataFrame:
    return df.agg(F.count(wkt).alias("features"))


def geo_summary(df: DataFrame, wkt: str = "geometry_wkt") -> DataFrame:
    """Row count, total box and geometry types of a table."""
    boxed = df if set(BOX) <= set(df.columns) else with_bounds(df, wkt)
    kind = F.col("geometry_type") if "geometry_type" in boxed.columns else g.geometry_type(F.col(wkt))
    return boxed.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.array_sort(F.collect_set(kind)).alias("geometry_types"),
    )


def together(rows: DataFrame, by: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """``by`` and an array ``name`` of the ``columns`` of rows that agree in ``by``, at most about ``MOST_TOGETHER`` in one."""
    keyed = rows.withColumn("_key", F.xxhash64(*by))
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_TOGETHER)
    # At most a row for MOST_TOGETHER rows of the table.
    dealt = keyed.join(F.broadcast(counts), "_key", "left")
    part = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_n") / MOST_TOGETHER)))
    own = F.struct(*[F.col(f"`{c}`") for c in columns])
    return dealt.withColumn("_part", part).groupBy(*by, "_part").agg(F.collect_list(own).alias(name)).drop("_part")


def spatial_join(
    points: DataFrame,
    shapes: DataFrame,
    lon: str = "lon",
    lat: str = "lat",
    wkt: str = "geometry_wkt",
    within_km: float | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Each point with every geometry that contains it, or that lies within a distance.

    Geometries go to the grid whose cells are at least half as wide as their (widened)
    box, so each fills at most nine cells and a cell holds little that is far away; a
    point goes to one cell of every grid in use. A pair meets in exactly one cell, so
    nothing is de-duplicated, and the equi-join on the cell is one that adaptive
    execution can split where points crowd. Points at one place and geometries of one text
    are tested once, as a list each, and the pairs that are left are spelled out last.
    ``decimals`` rounds ``distance_km`` as ``F.round`` does, before pairs are spelled out.
    """
    reach = 0.0
    if within_km is not None:
        check_radius(within_km)
        reach = within_km / g.KM_PER_DEGREE
    sizes = list(CELL_SIZES)
    stored = set(BOX) <= set(shapes.columns)
    # The text itself goes once with each list, not with each of its rows, unless a collation takes different texts as equal.
    once = {f.name for f in shapes.schema if f.name == wkt and f.dataType == StringType()}
    kept = [c for c in shapes.columns if c not in once] or [wkt]
    listed = together(shapes.where(F.col(wkt).isNotNull()), [wkt, *BOX] if stored else [wkt], kept, "_shapes")
    # Parsed once per text; the join carries the parsed form to the exact test.
    boxed = listed.withColumn("_shape", g.parse_wkt(F.col(wkt)))
    boxed = boxed.withColumn("_box", F.struct(*BOX) if stored else g.bounds(F.col("_shape")))
    if within_km is not None:
        # Most geometries are an outline of a few segments, which goes instead of the parsed form.
        boxed = boxed.withColumn("_outline", g.outline(F.col("_shape"))).withColumns({
            "_area": F.get(F.col("_shape"), F.lit(0))["kind"] == "area", "_shape": F.when(F.col("_outline").isNull(), F.col("_shape"))})
    # An empty geometry has no box; exploding its cells below drops it.
    boxed = boxed.withColumn("_box", F.struct(
        (F.col("_box.minx") - reach).alias("minx"), (F.col("_box.miny") - reach).alias("miny"),
        (F.col("_box.maxx") + reach).alias("maxx"), (F.col("_box.maxy") + reach).alias("maxy")))
    extent = F.greatest(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxy") - F.col("_box.miny"))
    size = size_of(F.col("_level"), sizes)
    levelled = boxed.withColumn("_level", grid_level(extent / 2, sizes))
    across = F.sequence(cell(F.col("_box.minx"), size), cell(F.col("_box.maxx"), size))
    down = F.sequence(cell(F.col("_box.miny"), size), cell(F.col("_box.maxy"), size))
    cells = F.flatten(F.transform(across, lambda cx: F.transform(down, lambda cy: F.struct(
        cx.alias("_cx"), cy.alias("_cy"), *[F.col(f"_box.{n}").alias(f"_{n}") for n in BOX]))))
    # The outer generator keeps Spark from deriving row filters that would parse the text again.
    form = ["_shape"] if within_km is None else ["_shape", "_outline", "_area"]
    placed = join_by_size(levelled.select(F.col(wkt).alias("_text"), "_shapes", *form, "_level", F.inline_outer(cells)), shapes)
    x, y = F.col("_x"), F.col("_y")
    # A scalar subquery that lists the grids in use (at most nine numbers).
    in_use = levelled.agg(F.collect_set("_level")).scalar()
    at = points.withColumns({"_x": F.col(lon).cast("double"), "_y": F.col(lat).cast("double")}).where(x.isNotNull() & y.isNotNull())
    spread = (
        together(at, ["_x", "_y"], points.columns, "_points")
        .withColumn("_level", F.explode(in_use))
        .withColumns({"_cx": cell(x, size), "_cy": cell(y, size)})
    )
    met = spread.join(placed, ["_level", "_cx", "_cy"]).where(
        x.between(F.col("_minx"), F.col("_maxx")) & y.between(F.col("_miny"), F.col("_maxy")))
    shape = F.col("_shape")
    if within_km is None:
        met = met.where(g.contains_point(shape, x, y))
    else:
        # One step works out all three: the function over arrays in it keeps it apart from the join, so it is compiled in small
        # methods. As part of the join's one method it would be too long for the JVM's compiler.
        line = F.col("_outline")
        met = met.withColumns({
            "_square": g.outline_square(line, x, y), "_inside": F.col("_area") & g.outline_encloses(line, x, y),
            "_other": F.when(line.isNull(), g.distance(shape, x, y))})
        away = F.coalesce("_other", F.when(F.col("_inside"), 0.0), F.sqrt("_square"))
        met = keep_within(met, away, reach)
        km = F.col("_degrees") * g.KM_PER_DEGREE
        met = met.withColumn("distance_km", km if decimals is None else g.rounded(km, decimals)).drop("_degrees")
    more = ["distance_km"] if within_km is not None else []
    # Compiled generators hold all rows of an input row at once. The first one is kept from being compiled by its function,
    # so a task holds the pairs of one geometry and one list of points, not of two lists.
    pairs = met.select("_points", "_text", F.explode(F.transform("_shapes", lambda s: s)).alias("_geometry"), *more)
    pairs = pairs.select(F.explode("_points").alias("_point"), "_text", "_geometry", *more)
    own = [F.col("_text").alias(wkt) if c in once else F.col(f"_geometry.`{c}`") for c in shapes.columns]
    return pairs.select("_point.*", *own, *more)
