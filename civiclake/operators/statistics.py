"""Column statistics kept per file and merged, so that a grown table is profiled by reading its new files only.

Each file of a Parquet table leaves one row per column: counts, extremes, mean and squared deviations, and two mergeable sketches
(distinct values: HyperLogLog; quantiles of numbers: KLL). They are written beside the table. A profile merges the rows of
the files that the table has now, so files that are gone no longer count.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KLL_SIZE = 400  # ranks within about 0.7 percent
HLL_BITS = 14  # distinct counts within about 0.8 percent
SCHEMA = (
    "file string, column string, position int, type string, n long, n_null long, n_number long, low string, high string, low_number double, high_number double, "
    "mean double, deviations double, hll binary, kll binary"
)


def _column_row(position: int, field: T.StructField) -> Column:
    """The statistics of one column within a group."""
    col = F.col(f"`{field.name}`")
    numeric = isinstance(field.dataType, T.NumericType)
    nested = isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
    text = F.to_json(col) if nested else col.cast("string")
    number = col.cast("double") if numeric else F.lit(None).cast("double")
    counted = F.when(~F.isnan(number), number)
    kept = F.count(counted)
    return F.struct(
        F.lit(field.name).alias("column"), F.lit(position).alias("position"), F.lit(field.dataType.simpleString()).alias("type"),
        F.count(F.lit(1)).alias("n"), F.count_if(col.isNull()).alias("n_null"), kept.alias("n_number"),
        *[(F.lit(None).cast("string") if numeric else f(text)).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))],
        *[f(number).alias(n) for f, n in ((F.min, "low_number"), (F.max, "high_number"))],
        F.avg(counted).alias("mean"), F.when(kept > 0, F.var_pop(counted) * kept).alias("deviations"),
        F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("hll"),
        (F.kll_sketch_agg_double(counted, F.lit(KLL_SIZE)) if numeric else F.lit(None).cast("binary")).alias("kll"),
    )


def _plain(path: Column) -> Column:
    """One spelling of a file's address: Spark writes ``file:/x`` and ``file:///x`` for the same one."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")


def _files(spark: SparkSession, table: str) -> DataFrame:
    found = spark.createDataFrame([(f,) for f in spark.read.parquet(table).inputFiles()], "address string")
    return found.select("address", _plain(F.col("address")).alias("file"))


def file_statistics(df: DataFrame) -> DataFrame:
    """One row per file and column of a table that is read from files, in one scan with map-side sums."""
    fields = df.schema.fields
    rows = df.withColumn("_own_file", _plain(F.col("_metadata.file_path"))).groupBy("_own_file").agg(
        F.array(*[_column_row(i, f) for i, f in enumerate(fields)]).alias("columns"))
    return rows.select(F.col("_own_file").alias("file"), F.inline("columns"))


def update_statistics(spark: SparkSession, table: str, statistics: str) -> list[str]:
    """Add the statistics of the table's files that have none yet; returns the files read.

    Each call appends one folder of Parquet. A call that fails half-way leaves nothing behind that a later one would count twice:
    rows are told apart by file.
    """
    spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(statistics)
    have = spark.read.schema(SCHEMA).parquet(statistics).select("file").distinct()
    new = [unquote(r["address"]) for r in _files(spark, table).join(have, "file", "left_anti").collect()]  # paths, not rows
    if new:
        file_statistics(spark.read.parquet(*new)).write.mode("append").parquet(statistics)
    return new


def profile_merged(spark: SparkSession, table: str, statistics: str) -> DataFrame:
    """column_name, column_type, min, max, approx_unique, avg, std, q25, q50, q75, count, null_percentage, from kept statistics alone.

    Numbers that are not a number count as rows and not in averages and quantiles. min and max of other columns are in the order of their text.
    """
    kept = spark.read.schema(SCHEMA).parquet(statistics).join(_files(spark, table), "file", "left_semi").dropDuplicates(["file", "column"])
    own = F.col("n_number")
    sums = kept.groupBy("column").agg(
        F.min("position").alias("position"), F.max("type").alias("type"), F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"),
        F.try_divide(F.sum(F.col("mean") * own), F.sum(own)).alias("center"), F.hll_union_agg("hll").alias("hll"))
    quantiles = kept.where("kll is not null").groupBy("column").agg(F.kll_merge_agg_double("kll").alias("kll"))
    # Deviations from the common mean: those inside the files, and those of the files' means.
    spread = kept.join(sums.select("column", "center"), "column").groupBy("column").agg(
        F.sum(F.col("deviations") + own * F.pow(F.col("mean") - F.col("center"), 2)).alias("deviations"),
        F.sum(own).alias("counted"))
    rows = sums.join(spread, "column").join(quantiles, "column", "left")
    quart = [F.when(F.col("counted") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(q))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return rows.orderBy("position").select(
        F.col("column").alias("column_name"), F.col("type").alias("column_type"),
        F.coalesce("low", F.col("low_number").cast("string")).alias("min"), F.coalesce("high", F.col("high_number").cast("string")).alias("max"),
        F.hll_sketch_estimate("hll").alias("approx_unique"), F.col("center").alias("avg"),
        F.when(F.col("counted") > 1, F.sqrt(F.col("deviations") / (F.col("counted") - 1))).alias("std"), *quart,
        F.col("n").alias("count"), F.round(F.try_divide(F.col("n_null") * 100, F.col("n")), 2).alias("null_percentage"))
