"""Choose the reader for a resource, and land it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.functions.names import table_name
from civiclake.operators.spatial import geo_summary
from civiclake.sources.files import read_csv_by_name, read_geojson, read_json, read_kml
from civiclake.sources.pages import read_datastore_pages
from civiclake.sources.store import Store

TABULAR = {"CSV": read_csv_by_name, "TXT": read_csv_by_name, "JSON": read_json, "GEOJSON": read_geojson}
GEOGRAPHIC = {"GEOJSON": read_geojson, "KML": read_kml}


class UnsupportedFormat(ValueError):
    """No reader for this format."""


def read_resource(spark: SparkSession, path: str, fmt: str | None, datastore_active: bool = False, **options: Any) -> DataFrame:
    """The table behind a resource: datastore pages first, else by file format."""
    if not path:
        raise ValueError("The resource has neither a file nor datastore pages")
    if datastore_active:
        return read_datastore_pages(spark, path, **options)
    reader = TABULAR.get((fmt or "").upper())
    if reader is None:
        raise UnsupportedFormat(f"Cannot read format {(fmt or 'unknown').upper()} as a table: {path}")
    df = reader(spark, path, **options)
    if reader is read_geojson:
        return df.drop("geometry_type", "crs")
    return df


def read_geo_resource(spark: SparkSession, path: str, fmt: str | None, **options: Any) -> DataFrame:
    """A geographic resource with type, reference system and box columns."""
    reader = GEOGRAPHIC.get((fmt or "").upper())
    if reader is None:
        raise UnsupportedFormat(f"Cannot read format {(fmt or 'unknown').upper()} as geography: {path}")
    return reader(spark, path, bounds=True, **options)


def name_table(spark: SparkSession, dataset_name: str | None, resource_id: str, portal: str, geo: bool = False) -> str:
    one = spark.range(1).select(
        table_name(F.lit(dataset_name).cast("string"), F.lit(resource_id), F.lit(portal), geo).alias("name"))
    return one.first()["name"]


def ingest(
    store: Store,
    path: str,
    fmt: str | None,
    resource_id: str,
    dataset_id: str,
    dataset_name: str | None,
    portal: str,
    update_frequency: str | None = None,
    source_url: str = "",
    datastore_active: bool = False,
    geo: bool = False,
    force: bool = False,
    **options: Any,
) -> dict[str, Any]:
    """Read, repair and store one resource; a landed one is left alone unless forced."""
    row = store.registry().where(F.col("resource_id") == resource_id).first()
    if row is not None and not force:
        return {"status": "already_landed", "table_name": row["table_name"], "row_count": row["row_count"],
                "downloaded_at": row["downloaded_at"], "expires_at": row["expires_at"]}
    if geo:
        df = read_geo_resource(store.spark, path, fmt, **options)
    else:
        df = read_resource(store.spark, path, fmt, datastore_active, **options)
    name = store.free_name(name_table(store.spark, dataset_name, resource_id, portal, geo), resource_id)
    store.land(df, resource_id, dataset_id, name, source_url or path, update_frequency)
    landed = store.table(resource_id)
    report = {"status": "landed", "table_name": name, "columns": landed.dtypes}
    if geo:
        report.update(geo_summary(landed).first().asDict())
    return report
