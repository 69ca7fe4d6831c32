"""Read landed API pages: datastore records and catalogue records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.operators.query import drop_internal


class IncompletePages(ValueError):
    """Fewer records landed than the pages announce."""


def _pages(spark: SparkSession, path: str, schema: str | T.StructType | None, lines: bool) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _check(pages: DataFrame, total: str, records: str) -> None:
    row = pages.agg(F.max(total), F.sum(F.size(records))).first()
    if row[0] is not None and (row[1] or 0) < row[0]:
        raise IncompletePages(f"{row[1] or 0} of {row[0]} records landed")


def read_datastore_pages(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = False,
    check: bool = True, keep_internal: bool = False,
) -> DataFrame:
    """The records of all pages as rows, without the ``_`` bookkeeping columns.

    With ``check`` the landed records must reach the announced total.
    """
    pages = _pages(spark, path, schema, lines)
    if check:
        _check(pages, "result.total", "result.records")
    records = pages.select(F.explode("result.records").alias("r")).select("r.*")
    return records if keep_internal else drop_internal(records)


def read_catalog_pages(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = False, check: bool = True
) -> DataFrame:
    """The dataset records of all catalogue pages as rows."""
    pages = _pages(spark, path, schema, lines)
    if check:
        _check(pages, "result.count", "result.results")
    return pages.select(F.explode("result.results").alias("r")).select("r.*")
