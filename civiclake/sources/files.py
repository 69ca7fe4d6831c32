"""Read landed resource files: CSV, JSON, GeoJSON and KML.

A path may be one file, a folder or a glob; files are read in parallel, and formats
with one record per line are split further.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.functions.geometry import geometry_type
from civiclake.operators.spatial import with_bounds
from civiclake.operators.typing_repair import infer_types


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True, separator: str = ","
) -> DataFrame:
    """CSV with a header row, the same in every file.

    Without a schema the types are inferred from all rows in one aggregation. Fields
    may hold line breaks; ``multi_line=False`` lets large files without any be split.
    A file whose header has other names, or another order, than the schema (or the first file) raises an error, where Spark would
    read its values by place; ``read_csv_by_name`` takes such files.
    """
    reader = _csv(spark, separator, multi_line).option("enforceSchema", False)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return infer_types(reader.csv(path))


def _csv(spark: SparkSession, separator: str, multi_line: bool):
    return spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", multi_line)


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, header, broken: the first line of each file, and whether any field may hold a line break.

    One pass over the lines. A line with an odd number of quotes opens or closes a field with a break in it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    odd = F.regexp_count("value", F.lit('"')) % 2
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), (F.max(odd) == 1).alias("broken"))


def read_csv_by_name(spark: SparkSession, path: str, separator: str = ",", infer: bool = True) -> DataFrame:
    """CSV files whose headers differ in order or in names, as one table by column name.

    Files are grouped by their header line and read group by group; a column that a file does not have is null there. Files without
    a line break in a field are split among tasks, others are read whole. Columns stand in the order in which the files, by
    name, first have them. A header must be one line.
    """
    headers = csv_headers(spark, path).groupBy("header", "broken").agg(F.array_sort(F.collect_list("file")).alias("files"))
    groups = headers.orderBy(F.get("files", F.lit(0))).collect()  # one row per different header, with addresses of files
    if not groups:
        return spark.createDataFrame([], T.StructType())
    parts = [_csv(spark, separator, bool(g["broken"])).csv([unquote(f) for f in g["files"]]) for g in groups]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return infer_types(whole) if infer else whole


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: str | T.StructType | None = None) -> DataFrame:
    """An array of records per file, or (``lines``) a record per line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


# --- GeoJSON -------------------------------------------------------------------------

GEOMETRY = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"


def coordinates_wkt(kind: Column, coordinates: Column) -> Column:
    """WKT from a geometry's type and the JSON text of its coordinates."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    flat = F.regexp_replace(coordinates, r"\s+", "")
    # [x,y] or [x,y,z] to "x y" ; "x y z" stays whole
    pairs = F.regexp_replace(flat, rf"\[({number}),({number})\]", "$1 $2")
    triples = F.regexp_replace(pairs, rf"\[({number}),({number}),({number})\]", "$1 $2 $3")
    body = F.translate(F.replace(triples, F.lit(","), F.lit(", ")), "[]", "()")
    wrapped = F.when(kind == "Point", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)
    third = F.when(triples != pairs, "Z ").otherwise("")
    empty = F.coalesce(flat, F.lit("")).isin("", "[]")
    return F.when(kind.isNull(), None).when(empty, F.concat(F.upper(kind), F.lit(" EMPTY"))).otherwise(
        F.concat(F.upper(kind), F.lit(" "), third, wrapped))


def geometry_wkt(geometry: Column) -> Column:
    """WKT of a GeoJSON geometry struct; NULL if there is none."""
    members = F.transform(geometry["geometries"], lambda m: coordinates_wkt(m["type"], m["coordinates"]))
    collection = F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(members, ", "), F.lit(")"))
    return F.when(geometry["type"] == "GeometryCollection", collection).otherwise(
        coordinates_wkt(geometry["type"], geometry["coordinates"]))


def read_geojson(
    spark: SparkSession, path: str, properties: str | None = None, lines: bool = False, bounds: bool = False
) -> DataFrame:
    """One row per feature: its properties, ``geometry_wkt``, ``geometry_type`` and ``crs``.

    ``lines``: every line is a collection or a feature of its own. ``properties``: DDL of the
    properties; without it they are inferred from all features. ``bounds`` adds the box.
    """
    reader = spark.read.option("multiLine", not lines)
    if properties is None:
        seen = reader.json(path).schema
        inner = next((f.dataType.elementType for f in seen.fields if f.name == "features"), seen)
        kinds = {f.name: f.dataType for f in inner.fields} if isinstance(inner, T.StructType) else {}
        found = kinds.get("properties")
        inner_kind = found if isinstance(found, T.StructType) and found.fields else T.StringType()
    else:
        inner_kind = T.StructType.fromDDL(properties)
    # A structure, not a text of it: property names may hold spaces or hyphens.
    feature = T.StructType().add("properties", inner_kind).add("geometry", T.DataType.fromDDL(GEOMETRY))
    schema = T.StructType([
        T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature)), *feature.fields,
        T.StructField("crs", T.DataType.fromDDL("struct<properties:struct<name:string>>")),
    ])
    raw = reader.schema(schema).json(path)
    name = F.coalesce("crs.properties.name", F.lit("EPSG:4326"))
    own = F.when(F.col("type") == "Feature", F.array(F.struct("properties", "geometry")))
    rows = raw.select(name.alias("crs"), F.inline(F.coalesce("features", own)))
    out = rows.select(
        *([F.col("properties.*")] if isinstance(inner_kind, T.StructType) else []), geometry_wkt(F.col("geometry")).alias("geometry_wkt"), "crs")
    return _geo(out, bounds)


def _geo(rows: DataFrame, bounds: bool) -> DataFrame:
    names = [c for c in rows.columns if c not in ("geometry_wkt", "geometry_type", "crs")]
    typed = with_bounds(rows) if bounds else rows.withColumn("geometry_type", geometry_type(F.col("geometry_wkt")))
    box = ["minx", "miny", "maxx", "maxy"] if bounds else []
    return typed.select(*[F.col(f"`{c}`") for c in names], "geometry_wkt", "geometry_type", "crs", *box)


# --- KML ------------------------------------------------------------------------------

RING = "struct<LinearRing:struct<coordinates:string>>"
SHAPES = (
    "Point struct<coordinates:string>, LineString struct<coordinates:string>, "
    f"Polygon struct<outerBoundaryIs:{RING},innerBoundaryIs:array<{RING}>>"
)
PLACEMARK = (
    "name string, description string, " + SHAPES + ", MultiGeometry struct<"
    f"Point:array<struct<coordinates:string>>,LineString:array<struct<coordinates:string>>,"
    f"Polygon:array<struct<outerBoundaryIs:{RING},innerBoundaryIs:array<{RING}>>>>, "
    "ExtendedData struct<Data:array<struct<_name:string,value:string>>,"
    "SchemaData:struct<SimpleData:array<struct<_VALUE:string,_name:string>>>>"
)


def _high() -> Column:
    """Whether any vertex of a placemark has an altitude; the others then have 0, as KML has it."""
    number = r"[-+0-9.eE]+"
    return F.to_json(F.struct("Point", "LineString", "Polygon", "MultiGeometry")).rlike(f"{number},{number},{number}")


def _tuples(text: Column) -> Column:
    """KML coordinate tuples ``x,y[,z] x,y[,z]`` as ``x y[ z], x y[ z]``."""
    def vertex(part: Column) -> Column:
        flat = F.split(part, ",")
        tall = F.slice(F.concat(flat, F.array(F.lit("0"))), 1, 3)
        return F.array_join(F.when(F.col("_high"), tall).otherwise(F.slice(flat, 1, 2)), " ")

    return F.array_join(F.transform(F.split(F.btrim(text, F.lit(" \t\r\n")), r"\s+"), vertex), ", ")


def _polygon(shape: Column) -> Column:
    def ring(r: Column) -> Column:
        return F.concat(F.lit("("), _tuples(r["LinearRing"]["coordinates"]), F.lit(")"))

    holes = F.transform(F.coalesce(shape["innerBoundaryIs"], F.array().cast(f"array<{RING}>")), ring)
    return F.concat(F.lit("("), F.array_join(F.concat(F.array(ring(shape["outerBoundaryIs"])), holes), ", "), F.lit(")"))


def _member(kind: str, body: Column) -> Column:
    return F.concat(F.lit(f"{kind} "), F.when(F.col("_high"), "Z ").otherwise(""), body)


def placemark_wkt() -> Column:
    def line(shape: Column) -> Column:
        return F.concat(F.lit("("), _tuples(shape["coordinates"]), F.lit(")"))

    multi = F.col("MultiGeometry")
    points, lines, areas = (F.coalesce(F.size(multi[n]), F.lit(0)) for n in ("Point", "LineString", "Polygon"))

    def joined(name: str, shape) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(multi[name], shape), ", "), F.lit(")"))

    nothing = F.array().cast("array<string>")
    members = F.concat(
        F.coalesce(F.transform(multi["Point"], lambda s: _member("POINT", line(s))), nothing),
        F.coalesce(F.transform(multi["LineString"], lambda s: _member("LINESTRING", line(s))), nothing),
        F.coalesce(F.transform(multi["Polygon"], lambda s: _member("POLYGON", _polygon(s))), nothing))
    return (
        F.when(F.col("Point.coordinates").isNotNull(), _member("POINT", line(F.col("Point"))))
        .when(F.col("LineString.coordinates").isNotNull(), _member("LINESTRING", line(F.col("LineString"))))
        .when(F.col("Polygon.outerBoundaryIs").isNotNull(), _member("POLYGON", _polygon(F.col("Polygon"))))
        .when((points > 0) & (lines + areas == 0), _member("MULTIPOINT", joined("Point", line)))
        .when((lines > 0) & (points + areas == 0), _member("MULTILINESTRING", joined("LineString", line)))
        .when((areas > 0) & (points + lines == 0), _member("MULTIPOLYGON", joined("Polygon", _polygon)))
        .when(points + lines + areas > 0, F.concat(F.when(F.col("_high"), "GEOMETRYCOLLECTION Z (").otherwise("GEOMETRYCOLLECTION ("), F.array_join(members, ", "), F.lit(")")))
    )


def read_kml(
    spark: SparkSession, path: str, fields: list[str] | None = None, lines: bool = False, bounds: bool = False
) -> DataFrame:
    """One row per placemark: Name, Description, the named extended fields and the geometry.

    Without ``fields`` the names found in the data become columns. A document is streamed
    by one task; with ``lines`` (a placemark on each line) large files are split.
    """
    raw = spark.read.format("xml").option("rowTag", "Placemark").option("multiLine", not lines).schema(PLACEMARK).load(path)
    nothing = F.lit(None).cast("array<struct<_name:string,value:string>>")
    simple = F.transform("ExtendedData.SchemaData.SimpleData", lambda d: F.struct(d["_name"].alias("_name"), d["_VALUE"].alias("value")))
    pairs = F.map_from_entries(F.coalesce(F.col("ExtendedData.Data"), simple, nothing))
    rows = raw.withColumns({"_extra": pairs, "_high": _high()})
    if fields is None:
        # The names become columns, so the driver must know them: one short row per name.
        fields = [r[0] for r in rows.select(F.explode(F.map_keys("_extra")).alias("k")).distinct().orderBy("k").collect()]
    out = rows.select(
        F.col("name").alias("Name"), F.col("description").alias("Description"),
        *[F.col("_extra")[f].alias(f) for f in fields], placemark_wkt().alias("geometry_wkt"), F.lit("EPSG:4326").alias("crs"))
    return _geo(out, bounds)


# --- writing the same formats ------------------------------------------------------------

def feature_json(properties: list[str], wkt_free_geometry: Column) -> Column:
    """A GeoJSON feature as text, from property columns and the geometry's JSON text."""
    head = json.dumps({"type": "Feature"})[:-1]
    return F.concat(
        F.lit(head + ', "properties": '), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
        F.lit(', "geometry": '), F.coalesce(wkt_free_geometry, F.lit("null")), F.lit("}"))
