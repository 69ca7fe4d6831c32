"""Files and pages as portals send them."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from civiclake.session import work_dir
from civiclake.sources.files import csv_headers, read_csv, read_csv_by_name, read_geojson, read_json, read_kml
from civiclake.sources.hub import normalize_hub_catalog, normalize_hub_record
from civiclake.sources.pages import IncompletePages, read_catalog_pages, read_datastore_pages


@pytest.fixture
def put(tmp_path):
    def write(text, name="data"):
        path = tmp_path / f"{name}-{uuid.uuid4().hex}"
        path.write_text(text if isinstance(text, str) else json.dumps(text))
        return str(path)

    return write


def test_csv(spark, put):
    path = put('Min Delay,note,when\n5,"two\nlines, ""quoted""",2024-01-01\n,N/A,2024-01-02\n')
    df = read_csv(spark, path)
    assert df.dtypes == [("Min Delay", "double"), ("note", "string"), ("when", "string")]
    assert [tuple(r) for r in df.collect()] == [(5.0, 'two\nlines, "quoted"', "2024-01-01"), (None, None, "2024-01-02")]


def test_json(spark, put):
    assert [tuple(r) for r in read_json(spark, put([{"a": 1, "b": "x"}, {"a": 2}])).orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_geojson(spark, put):
    shapes = [
        ({"type": "Point", "coordinates": [1, 2.5]}, "POINT (1 2.5)", "Point"),
        ({"type": "LineString", "coordinates": [[0, 0], [1, -1e-3]]}, None, "LineString"),
        ({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]]},
         "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "Polygon"),
        ({"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, "MULTIPOINT (1 2, 3 4)", "MultiPoint"),
        ({"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "MultiPolygon"),
        ({"type": "Point", "coordinates": [1, 2, 3]}, "POINT Z (1 2 3)", "Point"),
        ({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}]},
         "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "GeometryCollection"),
        (None, None, None),
    ]
    features = [{"type": "Feature", "properties": {"n": i, "label": "x"}, "geometry": s} for i, (s, _, _) in enumerate(shapes)]
    path = put({"type": "FeatureCollection", "features": features, "crs": {"type": "name", "properties": {"name": "EPSG:2958"}}})
    rows = read_geojson(spark, path, bounds=True).orderBy("n").collect()
    assert rows[0].asDict().keys() == {"n", "label", "geometry_wkt", "geometry_type", "crs", "minx", "miny", "maxx", "maxy"}
    for row, (_, wkt, kind) in zip(rows, shapes):
        assert row["geometry_type"] == kind and row["crs"] == "EPSG:2958"
        if kind != "LineString":
            assert row["geometry_wkt"] == wkt
    assert (rows[6]["maxx"], rows[2]["maxy"], rows[1]["miny"], rows[7]["minx"]) == (1, 4, -0.001, None)
    lines = put("\n".join(json.dumps(f) for f in features))
    assert read_geojson(spark, lines, properties="n long", lines=True).where("geometry_wkt is not null").count() == 7


def test_kml(spark, put):
    path = put("""<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>doc</name>
 <Placemark><name>dot</name><description>d</description>
  <ExtendedData><SchemaData schemaUrl="#s"><SimpleData name="ward">7</SimpleData><SimpleData name="kind">a</SimpleData></SchemaData></ExtendedData>
  <Point><coordinates>-79.4,43.7,0</coordinates></Point></Placemark>
 <Folder><Placemark><name>way</name><LineString><coordinates>
   0,0,0
   1,1 2,0,7.5
 </coordinates></LineString></Placemark></Folder>
 <Placemark><name>area</name><ExtendedData><Data name="ward"><value>9</value></Data></ExtendedData>
  <Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,0</coordinates></LinearRing></outerBoundaryIs>
  <innerBoundaryIs><LinearRing><coordinates>1,0.5 2,0.5 2,1 1,0.5</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
 <Placemark><name>both</name><MultiGeometry><Point><coordinates>5,6</coordinates></Point><Point><coordinates>7,8</coordinates></Point></MultiGeometry></Placemark>
 <Placemark><name>nowhere</name></Placemark>
</Document></kml>""")
    rows = {r["Name"]: r for r in read_kml(spark, path).collect()}
    assert rows["dot"]["geometry_wkt"] == "POINT Z (-79.4 43.7 0)" and rows["dot"]["ward"] == "7" and rows["dot"]["kind"] == "a"
    assert rows["way"]["geometry_wkt"] == "LINESTRING Z (0 0 0, 1 1 0, 2 0 7.5)" and rows["way"]["geometry_type"] == "LineString"
    assert rows["area"]["geometry_wkt"] == "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))" and rows["area"]["ward"] == "9"
    assert rows["both"]["geometry_wkt"] == "MULTIPOINT ((5 6), (7 8))"
    assert rows["nowhere"]["geometry_wkt"] is None


def test_pages(spark, put, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for i, records in enumerate([[{"_id": 1, "name": "a"}, {"_id": 2, "name": "b"}], [{"_id": 3, "name": "c"}]]):
        (folder / f"{i}.json").write_text(json.dumps({"success": True, "result": {"total": 3, "records": records}}))
    df = read_datastore_pages(spark, str(folder))
    assert df.columns == ["name"] and sorted(r[0] for r in df.collect()) == ["a", "b", "c"]
    short = put({"success": True, "result": {"total": 5, "records": [{"_id": 1, "name": "a"}]}})
    with pytest.raises(IncompletePages, match="1 of 5"):
        read_datastore_pages(spark, short)
    catalog = put({"success": True, "result": {"count": 1, "results": [{"id": "x", "title": "X"}]}})
    assert [tuple(r) for r in read_catalog_pages(spark, catalog).collect()] == [("x", "X")]


def test_hub_shapes(spark, put):
    path = put({"features": [
        {"id": "f1", "properties": {"id": "abc", "title": "City  Cycling!", "description": None, "snippet": "short", "tags": ["bike"], "type": "Feature Service", "url": "http://x", "modified": "2025"}},
        {"id": "f2", "properties": {"title": "Sheet", "type": "Excel", "url": ""}}]})
    features = spark.read.option("multiLine", True).json(path).selectExpr("inline(features)")
    rows = {r["title"]: r for r in normalize_hub_catalog(features, "city", "The City").collect()}
    first, second = rows["City  Cycling!"], rows["Sheet"]
    assert (first["id"], first["name"], first["notes"], first["organization"]["title"]) == ("abc_0", "city-cycling", "short", "The City")
    assert first["resources"][0]["format"] == "Feature Service" and first["resources"][0]["datastore_active"] is False
    assert (second["id"], second["resources"], second["tags"], second["update_frequency"]) == ("f2", [], [], "unknown")
    record = spark.read.option("multiLine", True).json(put({"data": {"id": "abc_0", "attributes": {"id": "abc_0", "title": "Park Lots", "url": "http://x", "license": None}}}))
    row = normalize_hub_record(record, "city", "The City").first()
    assert (row["name"], row["license_title"], row["geographic_coverage"], row["resources"][0]["id"]) == ("park-lots", "", "The City", "abc_0")


def test_csv_with_another_header_order_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,amount\n1,x,2\n")
    (tmp_path / "b.csv").write_text("name,id,amount\ny,20,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path)).collect()


def test_csv_with_other_headers_is_read_by_name(spark, tmp_path):
    folder = tmp_path / "a folder%"
    folder.mkdir()
    (folder / "a.csv").write_text('id,name,amount\n1,x,2\n')
    (folder / "b.csv").write_text('name,id,amount\n"y, with ""quotes""",20,2.5\n')
    (folder / "c.csv").write_text('"id","Total EV","name"\n3,"4","z\nand more"\n4,"5","w"\n')
    (folder / "d.csv").write_text('id,name,amount\n')
    df = read_csv_by_name(spark, str(folder))
    assert df.columns == ["id", "name", "amount", "Total EV"]
    assert sorted(map(tuple, df.collect())) == [(1, "x", 2.0, None), (3, "z\nand more", None, 4), (4, "w", None, 5), (20, 'y, with "quotes"', 2.5, None)]
    broken = {r["header"].split(",")[0]: r["broken"] for r in csv_headers(spark, str(folder)).collect()}
    assert broken == {"id": False, "name": False, '"id"': True}
    big = spark.range(50_000).selectExpr("id", "concat('n', id) AS name")
    big.coalesce(1).write.option("header", True).csv(str(tmp_path / "big"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert read_csv_by_name(spark, str(tmp_path / "big"), infer=False).select(F.spark_partition_id()).distinct().count() > 3
        assert read_csv_by_name(spark, str(tmp_path / "big")).count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_geojson_property_names_of_any_form(spark, put):
    point = {"type": "Point", "coordinates": [1, 2]}
    path = put({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Min Delay": 5, "a-b": "x"}, "geometry": point}]})
    row = read_geojson(spark, path).first()
    assert row["Min Delay"] == 5 and row["a-b"] == "x" and row["geometry_wkt"] == "POINT (1 2)"
