"""Refresh of growing tables: only files that are new since the last refresh are read.

Each source folder is a file stream with an available-now trigger. Its checkpoint remembers the files that were taken; each batch is written to a folder
named by its number, so a batch that is run again after a lost driver replaces itself.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

STATUS = "table_name string, status string, rows_added long, error string"


class Growing(NamedTuple):
    """A table and the folder its files arrive in."""

    table_name: str
    folder: str
    schema: str
    format: str = "parquet"


def table_path(root: str, table_name: str) -> str:
    return f"{root.rstrip('/')}/{table_name}/rows"


def _take(spark: SparkSession, root: str, source: Growing) -> tuple:
    added = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{table_path(root, source.table_name)}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        added.append(batch.sparkSession.read.schema(source.schema).parquet(path).count())

    try:
        reader = spark.readStream.schema(source.schema).format(source.format)
        if source.format == "csv":
            reader = reader.option("header", True).option("enforceSchema", False)
        stream = reader.load(source.folder).writeStream.foreachBatch(keep).trigger(availableNow=True)
        stream.option("checkpointLocation", f"{root.rstrip('/')}/{source.table_name}/checkpoint").start().awaitTermination()
        return source.table_name, "refreshed", sum(added), None
    except Exception as exc:  # reported per table
        log.warning("refresh of %s failed", source.table_name, exc_info=True)
        return source.table_name, "error", sum(added), str(exc).split("\n")[0]


def refresh_incremental(spark: SparkSession, root: str, sources: Sequence[Growing], at_once: int = 4) -> DataFrame:
    """table_name, status, rows_added, error: one row per source, ``at_once`` side by side; one failure stops nothing."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        results = list(pool.map(lambda s: _take(spark, root, s), sources))
    return spark.createDataFrame(results, STATUS)


def read_growing(spark: SparkSession, root: str, source: Growing) -> DataFrame:
    """The table as of its last refresh."""
    return spark.read.schema(source.schema).parquet(table_path(root, source.table_name)).drop("batch")
