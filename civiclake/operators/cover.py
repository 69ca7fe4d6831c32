"""Points counted in shapes by a quadtree cover of each shape.

A shape is cut into grid cells at most an eighth as wide as itself or a little wider; each cell lies inside the shape or on its edge, others are
left out. Points are counted per cell first, so an inside cell adds one number to its shape and is never met by single points. Points in edge cells
take the exact test; an edge cell that holds many points is split into sixteen before that, as long as it stays crowded. Cells carry the id of their shape
only; a shape is parsed once, kept in the shared work folder and fetched by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions import geometry as g
from civiclake.operators.ranges import cell, grid_level, size_of
from civiclake.session import work_dir

SIZES = tuple(0.01 * 4**k for k in range(9))  # degrees
ACROSS = 8
CROWDED = 2_000  # points in an edge cell that is worth splitting
SLACK = 1e-9  # of a cell: a cell's border is a rounded product


def _flag(shape: Column, cx: Column, cy: Column, size: Column) -> Column:
    """``inside``, ``edge`` or NULL for a cell."""
    box = ((cx - SLACK) * size, (cy - SLACK) * size, (cx + 1 + SLACK) * size, (cy + 1 + SLACK) * size)
    return F.when(g.edge_meets_box(shape, box), "edge").when(g.contains_point(shape, (cx + 0.5) * size, (cy + 0.5) * size), "inside")


def _flagged(shape: Column, xs: Column, ys: Column, size: Column) -> Column:
    cells = F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(
        cx.alias("cx"), cy.alias("cy"), _flag(shape, cx, cy, size).alias("flag")))))
    return F.filter(cells, lambda c: c["flag"].isNotNull())


def cover(shapes: DataFrame) -> DataFrame:
    """id, level, cx, cy, flag of the cells of shapes (id, shape, minx, miny, maxx, maxy)."""
    size = size_of(F.col("level"), SIZES)
    span = lambda low, high: F.sequence(cell(F.col(low), size), cell(F.col(high), size))
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    levelled = shapes.withColumn("level", grid_level(extent / ACROSS, SIZES))
    return levelled.select("id", "level", F.inline(_flagged(F.col("shape"), span("minx", "maxx"), span("miny", "maxy"), size)))


def split_cells(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """The sixteen parts of each cell (id, level, cx, cy) that meet their shape."""
    fine = cells.join(shapes.select("id", "shape"), "id").withColumn("level", F.col("level") - 1)
    part = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col(c) * 4 + i)
    return fine.select("id", "level", F.inline(_flagged(F.col("shape"), part("cx"), part("cy"), size_of(F.col("level"), SIZES))))


def _placed(points: DataFrame, levels: list[int]) -> DataFrame:
    rows = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    size = size_of(F.col("level"), SIZES)
    return rows.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})


def count_in_shapes(
    points: DataFrame, shapes: DataFrame, shape_id: str, lon: str = "lon", lat: str = "lat", wkt: str = "geometry_wkt", crowded: int = CROWDED,
) -> DataFrame:
    """shape_id, points: how many points lie in the interior of each shape with geometry, none included.

    Rows without an id or a geometry, and points without coordinates, take no part. Shapes with one id are one shape as far as the count goes:
    a point in two of them counts twice.
    """
    spark = points.sparkSession
    folder = work_dir(spark, "cover")
    at = ["level", "cx", "cy"]

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    given = shapes.where(F.col(shape_id).isNotNull() & F.col(wkt).isNotNull()).select(F.col(shape_id).alias("own"), F.col(wkt).alias("wkt"))
    numbered = given.withColumn("id", F.struct("own", F.xxhash64("wkt"))).groupBy("id", "own").agg(F.first("wkt").alias("wkt"), F.count("*").alias("times"))
    parsed = numbered.withColumn("shape", g.parse_wkt(F.col("wkt")))
    parsed = written(parsed.withColumn("box", g.bounds(F.col("shape"))).select("id", "own", "times", "shape", "box.*"), "shapes")
    xy = points.select(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    # Points at one place are one row from here on.
    xy = written(xy.groupBy("x", "y").agg(F.count("*").alias("n")), "points")
    cells = written(cover(parsed.where("minx is not null")), "cells-0")
    done, round_ = [cells.where("flag = 'inside'")], 0
    edges = cells.where("flag = 'edge'")
    while True:
        levels = [r["level"] for r in edges.select("level").distinct().collect()]  # nine at most
        if not levels:
            break
        counts = _placed(xy, levels).groupBy(*at).agg(F.count("*").alias("places"))
        split = edges.join(counts.where(F.col("places") > crowded), at, "left_semi").where("level > 0")
        round_ += 1
        finer = written(split_cells(split, parsed), f"cells-{round_}")
        last = edges.where("level = 0").unionByName(edges.where("level > 0").join(counts.where(F.col("places") > crowded), at, "left_anti"))
        done += [finer.where("flag = 'inside'"), last]
        edges = finer.where("flag = 'edge'")
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    final = written(final, "final")
    levels = [r["level"] for r in final.select("level").distinct().collect()]
    placed = _placed(xy, levels or [0])
    whole = final.where("flag = 'inside'").join(placed.groupBy(*at).agg(F.sum("n").alias("n")), at).select("id", "n")
    near = final.where("flag = 'edge'").join(placed, at).select("id", "x", "y", "n").join(parsed.select("id", "shape"), "id")
    exact = near.where(g.contains_point(F.col("shape"), F.col("x"), F.col("y"))).select("id", "n")
    sums = whole.unionByName(exact).groupBy("id").agg(F.sum("n").alias("n"))
    rows = parsed.select("id", "own", "times").join(sums, "id", "left")
    return rows.groupBy(F.col("own").alias(shape_id)).agg(F.sum(F.coalesce("n", F.lit(0)) * F.col("times")).alias("points"))
