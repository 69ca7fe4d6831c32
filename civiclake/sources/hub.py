"""Bring hub catalogue records to the shape of the other portals' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.functions.names import slug

# Item types whose datasets carry a layer number in their id.
LAYERED = ("Feature Service", "Map Service")
DEFAULT_FORMAT = "Feature Service"
SLUG_LENGTH = 80

FILE = "struct<id:string,name:string,format:string,url:string,datastore_active:boolean>"


def _text(df: DataFrame, parent: str, name: str) -> Column:
    """A nested text field, or NULL if no record has it."""
    kind = df.schema
    for part in parent.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[part].dataType
    if not isinstance(kind, T.StructType) or name not in kind.names:
        return F.lit(None).cast("string")
    return F.col(f"{parent}.{name}")


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _files(identifier: Column, title: Column, kind: Column, url: Column) -> Column:
    """One file if there is a URL, else none."""
    one = F.array(F.struct(
        identifier.alias("id"), title.alias("name"), kind.alias("format"), url.alias("url"), F.lit(False).alias("datastore_active")))
    return F.when(_filled(url).isNotNull(), one.cast(f"array<{FILE}>")).otherwise(F.array().cast(f"array<{FILE}>"))


def _tags(df: DataFrame, parent: str) -> Column:
    """The tag list; empty where there is none or it is not a list."""
    nothing = F.array().cast("array<string>")
    found = _text(df, parent, "tags")
    listed = isinstance(df.select(found.alias("tags")).schema["tags"].dataType, T.ArrayType)
    return F.coalesce(found.cast("array<string>"), nothing) if listed else nothing


def _organization(name: str, title: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(title).alias("title"))


def normalize_hub_catalog(features: DataFrame, org_name: str, org_title: str) -> DataFrame:
    """Search features (``id``, ``properties``) to dataset records."""
    raw = F.coalesce(_filled(_text(features, "properties", "id")), F.col("id"), F.lit(""))
    kind = _or_empty(_text(features, "properties", "type"))
    identifier = F.when(kind.isin(*LAYERED), F.concat(raw, F.lit("_0"))).otherwise(raw)
    title = _or_empty(_text(features, "properties", "title"))
    return features.select(
        identifier.alias("id"),
        slug(title, "-", SLUG_LENGTH).alias("name"),
        title.alias("title"),
        F.coalesce(_filled(_text(features, "properties", "description")), _filled(_text(features, "properties", "snippet")), F.lit("")).alias("notes"),
        _or_empty(_text(features, "properties", "modified")).alias("metadata_modified"),
        _organization(org_name, org_title).alias("organization"),
        _tags(features, "properties").alias("tags"),
        _files(identifier, title, F.coalesce(_filled(kind), F.lit(DEFAULT_FORMAT)), _text(features, "properties", "url")).alias("resources"),
        F.lit("unknown").alias("update_frequency"),
    )


def normalize_hub_record(records: DataFrame, org_name: str, org_title: str) -> DataFrame:
    """Single-dataset answers (``data.attributes``) to dataset records."""
    def attr(name: str) -> Column:
        return _text(records, "data.attributes", name)

    identifier = F.coalesce(attr("id"), _text(records, "data", "id"))
    title = _or_empty(attr("title"))
    return records.select(
        identifier.alias("id"),
        F.coalesce(_filled(attr("name")), slug(title, "-", SLUG_LENGTH)).alias("name"),
        title.alias("title"),
        _or_empty(attr("description")).alias("notes"),
        _or_empty(attr("modified")).alias("metadata_modified"),
        _or_empty(attr("created")).alias("metadata_created"),
        _organization(org_name, org_title).alias("organization"),
        _tags(records, "data.attributes").alias("tags"),
        _files(identifier, title, F.lit(DEFAULT_FORMAT), attr("url")).alias("resources"),
        F.coalesce(_filled(attr("updateFrequency")), F.lit("unknown")).alias("update_frequency"),
        _or_empty(attr("license")).alias("license_title"),
        F.lit(org_title).alias("geographic_coverage"),
    )
