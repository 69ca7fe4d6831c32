"""Operators on the registry of landed tables (one row per resource)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.functions.names import bare_id, infer_portal
from civiclake.operators.staleness import with_staleness
from civiclake.portals import PORTALS, Portal

MEGABYTE = 1048576

REGISTRY_SCHEMA = (
    "resource_id string, dataset_id string, table_name string, downloaded_at timestamp_ntz, row_count long, "
    "size_bytes long, source_url string, expires_at timestamp_ntz"
)


def list_registry(registry: DataFrame) -> DataFrame:
    """All landed tables, newest first."""
    return registry.select(
        "resource_id", "dataset_id", "table_name", "downloaded_at", "row_count", "size_bytes", "source_url"
    ).orderBy(F.desc_nulls_last("downloaded_at"), "resource_id")


def registry_stats(registry: DataFrame) -> DataFrame:
    def total(name):
        return F.coalesce(F.sum(name), F.lit(0))

    return registry.agg(
        F.count(F.lit(1)).alias("table_count"), total("row_count").alias("total_rows"),
        total("size_bytes").alias("total_size_bytes"), F.round(total("size_bytes") / MEGABYTE, 2).alias("total_size_mb"),
    )


def lookup_resources(requests: DataFrame, registry: DataFrame, portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """Each requested (possibly prefixed) id with its registry row, if it is landed."""
    wanted = requests.withColumn("resource_id", bare_id(F.col("request"), portals))
    return wanted.join(registry, "resource_id", "left").withColumn("is_landed", F.col("table_name").isNotNull())


def registry_by_tables(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows of the tables named in ``names.table_name``."""
    return registry.join(names.select("table_name"), "table_name", "left_semi").select(
        "resource_id", "dataset_id", "table_name", "downloaded_at", "row_count", "expires_at")


def upsert(current: DataFrame, changes: DataFrame, key: str = "resource_id") -> DataFrame:
    """``current`` with the rows of ``changes`` put in place of those with the same key."""
    return current.join(changes.select(key), key, "left_anti").select(*current.columns).unionByName(changes)


def remove(current: DataFrame, gone: DataFrame, key: str = "resource_id") -> DataFrame:
    return current.join(gone.select(key), key, "left_anti").select(*current.columns)


def inventory(registry: DataFrame, now) -> DataFrame:
    """Every landed table with its size in MB and its staleness."""
    return with_staleness(registry, now).withColumn("size_mb", F.round(F.col("size_bytes") / MEGABYTE, 2))


def refresh_plan(registry: DataFrame, now, portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """The stale tables and the portal to load each of them from."""
    return (
        with_staleness(registry, now).where("is_stale")
        .select("resource_id", "dataset_id", "table_name", "source_url", infer_portal(F.col("table_name"), portals).alias("portal"))
    )


def pending_resources(requests: DataFrame, registry: DataFrame, portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """Requested ids that are not landed yet, once each."""
    return (
        requests.select(bare_id(F.col("request"), portals).alias("resource_id")).distinct()
        .join(registry.select("resource_id"), "resource_id", "left_anti")
    )
