"""The k nearest points of each probe, by two quadtrees of counts that are followed together from the top.

One square around targets and probes is cut into four cells, each of those into four, and so on. A level holds the number of targets of each cell,
and the box of the probes of each cell. A cell of probes starts with all target cells of a coarse level and goes down a level at a time. It sorts its
target cells by their greatest distance from its box; the distance at which they hold k targets together bounds the k-th neighbour of every probe
in it, so every target cell whose least distance is beyond it is let go. That is the stop, and it is proven: no target of a dropped cell can be among
the k nearest of any of these probes. A cluster, however large, is cut down to the cells around its probes. On the last level, chosen so that no cell holds
more than ``LEAF`` different places, the targets of the cells left are listed per cell of probes, and each place that is asked about measures that list.
Cells are shuffled and not probes, so what a level moves does not grow with the probes in a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclake.functions import geometry as g
from civiclake.operators.skew import spread_join
from civiclake.operators.spatial import check_radius
from civiclake.session import work_dir

DEEPEST = 40  # halvings of the square
STEP = 4  # levels added where cells are still crowded
LEAF = 16
FIRST_PAIRS = 1_000_000  # of a cell of probes and a cell of targets, that the way down may start with
MOST_LISTED = 2_000  # places in one list; a longer one is dealt over several rows
FEW = 100_000  # rows of a table that may be broadcast
SLACK, ROUNDING = 1e-9, 2e-15  # of a cell, and of the square's place and side


def _cell(value: Column, low: Column, side: Column, level: int) -> Column:
    n = 2**level
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - low) / side * n))).cast("long")


def _up(df: DataFrame, finest: int) -> DataFrame:
    """Rows of cells (cx, cy) of the finest level, with those of all levels above."""
    down = F.pow(F.lit(2.0), finest - F.col("level")).cast("long")
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(finest)))).withColumns({"cx": F.floor(F.col("cx") / down), "cy": F.floor(F.col("cy") / down)})


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if there are few rows, and else not, whatever the size of the files."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _gaps(low: str, high: str, cell: str, origin: Column, size: float, slack: float) -> tuple[Column, Column]:
    """Least and greatest distance, along one axis, of a side (low, high) from a cell's."""
    start, end = origin + (F.col(cell) - slack) * size, origin + (F.col(cell) + 1 + slack) * size
    return F.greatest(F.lit(0.0), start - F.col(high), F.col(low) - end), F.greatest(end - F.col(low), F.col(high) - start)


def nearest_k_join(
    probes: DataFrame, targets: DataFrame, k: int, probe_id: str, target_id: str, lon: str = "lon", lat: str = "lat", within_km: float | None = None,
) -> DataFrame:
    """probe_id, rank, target_id, distance_km: the ``k`` nearest targets of each probe, nearest first, ties to the smaller target_id.

    Distances are planar, at 111 km per degree. A probe with fewer than ``k`` targets (within ``within_km``) gets all of them; one with none, or without
    coordinates, gets no row. Targets without coordinates take no part. Repeated probe ids are answered once per different place.
    """
    if k < 1:
        raise ValueError(f"k: {k!r}")
    reach = None
    if within_km is not None:
        check_radius(within_km)
        reach = within_km / g.KM_PER_DEGREE
    spark = probes.sparkSession
    folder = work_dir(spark, "nearest")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def placed(df: DataFrame, key: str, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias(name), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
        return rows.where("not isnan(x) and not isnan(y) and abs(x) < double('Infinity') and abs(y) < double('Infinity')")

    # Of the targets at one place only the k of smallest id can be wanted.
    by_id = Window.partitionBy("x", "y").orderBy("target")
    first = placed(targets, target_id, "target").where("target is not null").distinct().withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= k)
    spots = written(first.groupBy("x", "y").agg(F.sort_array(F.collect_list("target")).alias("ids")), "spots")
    asked = placed(probes, probe_id, "probe").distinct()
    places = written(asked.select("x", "y").distinct(), "places")
    corner = [F.min("x"), F.min("y"), F.max("x"), F.max("y")]
    schema = f"`{probe_id}` {dict(probes.dtypes)[probe_id]}, rank int, `{target_id}` {dict(targets.dtypes)[target_id]}, distance_km double"
    around, around_probes = spots.agg(*corner).first(), places.agg(*corner).first()
    if around[0] is None or around_probes[0] is None:
        return spark.createDataFrame([], schema)
    low_x, low_y = min(around[0], around_probes[0]), min(around[1], around_probes[1])
    high_x, high_y = max(around[2], around_probes[2]), max(around[3], around_probes[3])
    side = max(high_x - low_x, high_y - low_y) or 1.0
    ox, oy, width = F.lit(low_x), F.lit(low_y), F.lit(side)

    def in_cells(df: DataFrame, level: int) -> DataFrame:
        return df.withColumns({"cx": _cell(F.col("x"), ox, width, level), "cy": _cell(F.col("y"), oy, width, level)})

    # Places and the targets that count (k at most of each) per cell of every level, as deep as it takes.
    n_spots = spots.count()
    finest = min(DEEPEST, max(1, math.ceil(math.log2(max(1.0, n_spots / LEAF)) / 2) + 2))
    while True:
        cells = in_cells(spots, finest).groupBy("cx", "cy").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("places"))
        counts = written(_up(cells, finest).groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"), F.sum("places").alias("places")), f"counts-{finest}")
        sizes = {r["level"]: r for r in counts.groupBy("level").agg(F.max("places").alias("most"), F.count("*").alias("cells")).collect()}
        if sizes[finest]["most"] <= LEAF or finest == DEEPEST:
            break
        finest = min(DEEPEST, finest + STEP)
    last = next((level for level in range(finest + 1) if sizes[level]["most"] <= LEAF), finest)
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    sides = in_cells(places, last).select("cx", "cy", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    boxes = written(_up(sides.groupBy("cx", "cy").agg(*box), last).groupBy("level", "cx", "cy").agg(*box), "boxes")
    asking = {r["level"]: r["cells"] for r in boxes.groupBy("level").agg(F.count("*").alias("cells")).collect()}

    own = Window.partitionBy("up_px", "up_py", "px", "py")
    half = lambda c: F.floor(F.col(c) / 2)
    front = None
    for level in range(max(x for x in range(last + 1) if x == 0 or sizes[x]["cells"] * asking[x] <= FIRST_PAIRS), last + 1):
        held = counts.where(F.col("level") == level).select(half("cx").alias("up_x"), half("cy").alias("up_y"), "cx", "cy", "n", "places")
        asked_in = boxes.where(F.col("level") == level).select(
            half("cx").alias("up_px"), half("cy").alias("up_py"), F.col("cx").alias("px"), F.col("cy").alias("py"), "x0", "y0", "x1", "y1")
        if front is None:
            met = asked_in.crossJoin(held).withColumn("far", F.lit(None).cast("double"))
        else:
            met = front.join(_few(held, sizes[level]["cells"]), ["up_x", "up_y"]).join(_few(asked_in, asking[level]), ["up_px", "up_py"])
        slack = SLACK + ROUNDING * 2**level * (1 + max(map(abs, (low_x, low_y, high_x, high_y))) / side)
        (near_x, far_x), (near_y, far_y) = (_gaps(f"{c}0", f"{c}1", f"c{c}", o, side / 2**level, slack) for c, o in (("x", ox), ("y", oy)))
        met = met.withColumns({"least": F.sqrt(near_x * near_x + near_y * near_y), "most": F.sqrt(far_x * far_x + far_y * far_y)})
        # A box lies in the one above it, whose bound holds for it as well.
        met = met.where(F.col("far").isNull() | (F.col("least") <= F.col("far")))
        met = met.withColumn("held", F.sum("n").over(own.orderBy("most", "cx", "cy")))
        met = met.withColumn("bound", F.least("far", F.min(F.when(F.col("held") >= k, F.col("most"))).over(own)))
        kept = F.col("bound").isNull() | (F.col("least") <= F.col("bound"))
        met = met.where(kept if reach is None else kept & (F.col("least") <= reach))
        if level < last:
            met = met.select(F.col("px").alias("up_px"), F.col("py").alias("up_py"), F.col("cx").alias("up_x"), F.col("cy").alias("up_y"), F.col("bound").alias("far"))
        else:
            met = met.select("px", "py", "cx", "cy", "places")
        front = written(met, f"front-{level}")

    # The targets of the cells left, as lists per cell of probes.
    parts = front.groupBy("px", "py").agg(F.ceil(F.sum("places") / MOST_LISTED).alias("parts")).where(F.col("parts") > 1)
    listed = front.join(parts, ["px", "py"], "left").join(_few(in_cells(spots, last), n_spots), ["cx", "cy"])
    listed = listed.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("x", "y"), F.col("parts"))))
    listed = listed.groupBy("px", "py", "part").agg(F.collect_list(F.struct(F.col("x").alias("tx"), F.col("y").alias("ty"), "ids")).alias("there"))
    here = in_cells(places, last).withColumnsRenamed({"cx": "px", "cy": "py"})
    met = spread_join(here, listed.drop("part"), ["px", "py"], "inner", merge=True)
    measured = F.transform("there", lambda c: F.struct(
        F.sqrt(F.pow(c["tx"] - F.col("x"), 2) + F.pow(c["ty"] - F.col("y"), 2)).alias("degrees"), c["ids"].alias("ids")))
    met = met.select("x", "y", (measured if reach is None else F.filter(measured, lambda c: c["degrees"] <= reach)).alias("there"))
    # The nearest places first, those as far as the k-th included, then their targets.
    farthest = F.get(F.sort_array(F.transform("there", lambda c: c["degrees"])), F.least(F.lit(k), F.size("there")) - 1)
    met = met.withColumn("farthest", farthest).select("x", "y", F.filter("there", lambda c: c["degrees"] <= F.col("farthest")).alias("there"))
    single = F.flatten(F.transform("there", lambda c: F.transform(c["ids"], lambda i: F.struct(c["degrees"].alias("degrees"), i.alias("target")))))
    found = met.select("x", "y", F.slice(F.sort_array(single), 1, k).alias("found"))
    found = found.groupBy("x", "y").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    near = spread_join(asked, found, ["x", "y"], "inner", merge=True).select("probe", F.posexplode("found").alias("place", "c"))
    return near.select(
        F.col("probe").alias(probe_id), (F.col("place") + 1).alias("rank"), F.col("c.target").alias(target_id), (F.col("c.degrees") * g.KM_PER_DEGREE).alias("distance_km"))
