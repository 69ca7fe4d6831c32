"""Column statistics and duplicate rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = 200  # columns per aggregation, so that generated code stays small

_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _stats(field: T.StructField):
    col = F.col(f"`{field.name}`")
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("double")
    nested = isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
    comparable = F.to_json(col) if nested else col
    numeric = isinstance(field.dataType, T.NumericType)
    ordered = isinstance(field.dataType, _ORDERED)
    quart = F.percentile_approx(col, [0.25, 0.5, 0.75], 10000) if ordered else None
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("column_type"),
        F.min(comparable).cast("string").alias("min"),
        F.max(comparable).cast("string").alias("max"),
        F.approx_count_distinct(comparable).alias("approx_unique"),
        (F.avg(col).cast("double") if numeric else number).alias("avg"),
        (F.stddev_samp(col.cast("double")) if numeric else number).alias("std"),
        *[(quart[i].cast("string") if ordered else text).alias(q) for i, q in enumerate(("q25", "q50", "q75"))],
        F.count(F.lit(1)).alias("count"),
        F.round(F.try_divide(F.count_if(col.isNull()) * 100, F.count(F.lit(1))), 2).alias("null_percentage"),
    )


def profile(df: DataFrame) -> DataFrame:
    """One row of statistics per column, from one scan (one per 200 columns)."""
    fields = df.schema.fields
    parts = []
    for start in range(0, len(fields), WIDE):
        chunk = fields[start:start + WIDE]
        row = df.agg(*[_stats(f).alias(f"s{i}") for i, f in enumerate(chunk)])
        parts.append(row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(chunk))]))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


MAP_BITS = 26  # a bit per hash prefix: 8 MB, whatever the number of rows


def _keyed(df: DataFrame) -> DataFrame:
    """Comparable forms of all columns in ``row``, and two 64-bit hashes of them."""
    keys = [
        F.to_json(f"`{f.name}`").alias(f.name)
        if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    rows = df.select(F.struct(*keys).alias("row"))
    # A null leaves a hash as it is; beside each value stands whether it is there.
    there = [F.col("row")[f.name].isNull() for f in df.schema.fields]
    return rows.withColumns({"one": F.xxhash64("row", *there), "two": F.xxhash64(F.lit(2), "row", *there)})


def _repeats(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows whose hash may be in ``counts``: those whose bit is set in a map of fixed size that every task holds."""
    def place(one: Column) -> Column:
        return F.shiftrightunsigned(one, 64 - MAP_BITS)

    maps = counts.groupBy(F.shiftright(place(F.col("one")), 15).alias("block")).agg(
        F.bitmap_construct_agg(place(F.col("one")).bitwiseAND(F.lit(32767))).alias("bits"))
    bit = place(F.col("one")).bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = keyed.withColumn("block", F.shiftright(place(F.col("one")), 15)).join(F.broadcast(maps), "block")  # 2,048 rows of 4 kB at most
    return marked.where(F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("block", "bits")


def _repeated(df: DataFrame) -> DataFrame:
    """``row`` and ``copies`` of each tuple that occurs more than once.

    Two hashes of a row are counted first; whole rows are only shuffled where a hash occurs twice, and then compared by value.
    """
    keyed = _keyed(df)
    twice = keyed.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _repeats(keyed, twice).groupBy("row").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def repeated_rows(df: DataFrame) -> DataFrame:
    """Each tuple that occurs more than once, with how often in ``copies``. NULLs compare equal."""
    return _repeated(df).select("row.*", "copies")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows, all members counted, have a twin."""
    return _repeated(df).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """Row count and duplicate rows."""
    twins = duplicate_rows(df).select("duplicate_rows").scalar()
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", twins.alias("duplicate_rows"))
