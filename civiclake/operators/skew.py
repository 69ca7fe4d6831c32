"""Joins whose left side crowds on a few keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.01
MOST_PARTS = 32


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: float = SHARE, most: int = MOST_PARTS) -> DataFrame:
    """keys and ``_parts``: the keys that hold more than a share of all rows, with how many parts they are worth.

    There are fewer than ``1 / share`` of them. Rows are counted in the map tasks first.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    parts = F.ceil(F.col("_n") / (total * share))
    return counts.where(F.col("_n") > total * share).select(*keys, F.least(F.lit(most), parts).cast("int").alias("_parts"))


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", heavy_on: Sequence[str] | None = None, counted: DataFrame | None = None,
    share: float = SHARE, most: int = MOST_PARTS, merge: bool = False,
) -> DataFrame:
    """Equi-join that deals the left rows of heavy keys over several tasks.

    ``right`` is the reduced side, of few rows for each key: adaptive execution cannot split such a join where a grouping made it. Only the
    right rows of heavy keys are repeated, once for each part. ``heavy_on`` names the key columns that are looked at (all of ``on``), and
    ``counted`` a cheaper table to count them in. ``how`` is inner or left. ``merge`` rules out that either side is broadcast, for rows that are
    much larger or more than Spark can foresee.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how!r}")
    keys = list(heavy_on or on)
    heavy = F.broadcast(heavy_keys(counted if counted is not None else left, keys, share, most))  # fewer than 1 / share rows
    own = [F.col(f"`{c}`") for c in left.columns]
    dealt = left.join(heavy, keys, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*own), F.col("_parts")).cast("int")))
    copied = right.join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    copied = copied.drop("_parts")
    return dealt.drop("_parts").join(copied.hint("merge") if merge else copied, [*on, "_part"], how).drop("_part")
