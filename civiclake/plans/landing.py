"""Source formats: each query writes a table in the format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.operators.query import drop_internal
from civiclake.plans.fixtures import DATASETS, GEO_POLYS, MESSY, datasets, geo_polys, messy
from civiclake.plans.suite import Suite
from civiclake.operators.catalog import split_catalog
from civiclake.session import work_dir
from civiclake.sources.files import feature_json, read_csv, read_csv_by_name, read_geojson, read_json, read_kml
from civiclake.sources.hub import normalize_hub_catalog, normalize_hub_record
from civiclake.sources.incremental import Growing, read_growing, refresh_incremental
from civiclake.sources.pages import read_catalog_pages, read_datastore_pages
from civiclake.sources.store import Store

LANDING = Suite()

PAGE = 500  # records per landed page


@LANDING.query("scan_csv", """
SELECT p_partkey, p_name, p_size, p_retailprice, concat(p_brand, ', "', p_type, '"', chr(10), 'end') AS note, CASE WHEN p_size > 40 THEN NULL ELSE p_size::DOUBLE END AS gaps FROM part""")
def scan_csv(t):
    """Quotes, separators, line breaks and gaps survive; types come from the data."""
    path = work_dir(t.spark, "csv")
    t.part.select(
        "p_partkey", "p_name", F.col("p_size").cast("long"), "p_retailprice",
        F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"\nend')).alias("note"),
        F.when(F.col("p_size") <= 40, F.col("p_size")).alias("gaps"),
    ).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return read_csv(t.spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@LANDING.query("scan_csv_reordered", """
SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS BIGINT) END AS p_size, CASE WHEN p_partkey % 3 = 2 THEN concat(p_brand, chr(10), 'x') END AS "The Note" FROM part""")
def scan_csv_reordered(t):
    """One dataset in three landings: the same columns in another order, then one column less and another one, with line breaks."""
    path = work_dir(t.spark, "csv")
    size = F.col("p_size").cast("long")
    shapes = [["p_partkey", "p_name", size], [size, "p_name", "p_partkey"], ["p_name", F.concat("p_brand", F.lit("\nx")).alias("The Note"), "p_partkey"]]
    for i, shape in enumerate(shapes):
        rows = t.part.where(F.col("p_partkey") % 3 == i).select(*shape)
        rows.write.option("header", True).option("escape", '"').option("quoteAll", i == 2).mode("append").csv(path)
    return read_csv_by_name(t.spark, path).select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"), "The Note")


@LANDING.query("scan_json", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id IS NOT NULL")
def scan_json(t):
    path = work_dir(t.spark, "json")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return read_json(t.spark, path, lines=True)


def ring(*corners):
    return F.concat(F.lit("[["), F.array_join(F.array(*[
        F.concat(F.lit("["), x, F.lit(", "), y, F.lit("]")) for x, y in corners]), ", "), F.lit("]]"))


@LANDING.query("scan_geojson", f"""
SELECT id, x1 AS east, CASE WHEN id % 10 = 0 THEN NULL ELSE geometry_wkt END AS geometry_wkt, CASE WHEN id % 10 != 0 THEN 'Polygon' END AS geometry_type, 'EPSG:4326' AS crs FROM {GEO_POLYS}""")
def scan_geojson(t):
    """Feature collections of up to a page of features, one collection per line."""
    path = work_dir(t.spark, "geojson")
    polys = geo_polys(t)
    corners = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    shape = F.when(F.col("id") % 10 != 0, F.concat(F.lit('{"type": "Polygon", "coordinates": '), corners, F.lit("}")))
    features = polys.withColumn("east", F.col("x1")).select("id", feature_json(["id", "east"], shape).alias("feature"))
    collections = features.groupBy(F.floor(F.col("id") / PAGE).alias("page")).agg(F.collect_list("feature").alias("features")).select(
        F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("features", ", "), F.lit("]}")).alias("value"))
    collections.write.text(path)
    return read_geojson(t.spark, path, lines=True)


@LANDING.query("scan_kml", f"""
SELECT concat('shape ', id) AS "Name", CAST(NULL AS VARCHAR) AS "Description", CAST(x0 AS VARCHAR) AS west,
 CASE WHEN id % 2 = 0 THEN concat('POLYGON Z ((', x0, ' ', y0, ' 0, ', x1, ' ', y0, ' 0, ', x1, ' ', y1, ' 0, ', x0, ' ', y1, ' 0, ', x0, ' ', y0, ' 0))')
  ELSE concat('POINT (', x0, ' ', y0, ')') END AS geometry_wkt, CASE WHEN id % 2 = 0 THEN 'Polygon' ELSE 'Point' END AS geometry_type,
 'EPSG:4326' AS crs FROM {GEO_POLYS}""")
def scan_kml(t):
    path = work_dir(t.spark, "kml")
    pairs = F.array_join(F.array(*[
        F.concat(x, F.lit(","), y, F.lit(",0")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]), " ")
    area = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates> "), pairs, F.lit(" </coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    dot = F.concat(F.lit("<Point><coordinates>"), "x0", F.lit(","), "y0", F.lit("</coordinates></Point>"))
    geo_polys(t).select(F.concat(
        F.lit("<Placemark><name>shape "), "id", F.lit('</name><ExtendedData><Data name="west"><value>'), "x0",
        F.lit("</value></Data></ExtendedData>"), F.when(F.col("id") % 2 == 0, area).otherwise(dot), F.lit("</Placemark>")).alias("value"),
    ).write.text(path)
    return read_kml(t.spark, path, lines=True)


def datastore(t):
    """Customers as datastore pages of 500 records, with bookkeeping fields."""
    path = work_dir(t.spark, "datastore")
    total = t.customer.agg(F.count(F.lit(1))).scalar()
    record = F.struct(
        F.col("c_custkey").alias("_id"), F.lit("'a':1").alias("_full_text"), "c_custkey", "c_name", F.col("c_acctbal").alias("Account Balance"))
    pages = t.customer.groupBy(F.floor(F.col("c_custkey") / PAGE).alias("page")).agg(F.collect_list(record).alias("records"))
    # Every page announces the total.
    pages.select(
        F.lit(True).alias("success"), F.struct(total.alias("total"), "records").alias("result")).write.json(path)
    return path


@LANDING.query("datastore_pages", 'SELECT c_custkey, c_name, c_acctbal AS "Account Balance" FROM customer')
def datastore_pages(t):
    return read_datastore_pages(t.spark, datastore(t), lines=True)


@LANDING.query("strip_internal", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def strip_internal(t):
    return drop_internal(t.lineitem.select("l_orderkey", F.lit(1).alias("_id"), "l_quantity", F.lit("x").alias("_full_text"), "l_tax"))


def catalog_files(t):
    """The catalogue as landed pages of nested records.

    The files of a dataset are nested in portal answers; here each record carries the
    files of one group of orders, so no record grows with the table.
    """
    path = work_dir(t.spark, "catalog")
    d = datasets(t)
    record = F.struct(
        "id", "name", "title", "notes", F.struct(F.col("org_name").alias("name"), F.col("org_title").alias("title")).alias("organization"),
        F.transform("tags", lambda x: F.struct(x.alias("name"))).alias("tags"), "update_frequency", "metadata_modified", "license_title",
        F.struct(F.col("maintainer_en").alias("en")).alias("maintainer_translated"), "maintainer",
        F.array(F.struct(
            F.concat(F.lit("f-"), "id").alias("id"), F.lit("table").alias("name"), F.lit("CSV").alias("format"), F.length("notes").alias("size"),
            F.lit("").alias("last_modified"), F.col("metadata_modified").alias("data_last_updated"))).alias("resources"),
    )
    total = t.part.agg(F.count(F.lit(1))).scalar()
    pages = d.groupBy(F.floor(F.col("id").cast("long") / PAGE).alias("page")).agg(F.collect_list(record).alias("results"))
    pages.select(F.lit(True).alias("success"), F.struct(total.alias("count"), "results").alias("result")).write.json(path)
    return path


@LANDING.query("catalog_pages", f"""
SELECT 'province' AS portal, id, title, org_title, array_to_string(tags, ',') AS tags, update_frequency, metadata_modified, maintainer_en, license_title,
 concat('f-', id) AS resource_id, 'CSV' AS format, CAST(length(notes) AS BIGINT) AS size, metadata_modified AS last_modified FROM {DATASETS}""")
def catalog_pages(t):
    """Pages read back and split into the two catalogue tables, then joined again."""
    d, r = split_catalog(read_catalog_pages(t.spark, catalog_files(t), lines=True), "province")
    files = r.select(F.col("package_id").alias("id"), F.col("id").alias("resource_id"), "format", "size", "last_modified")
    return d.join(files, "id").select(
        "portal", "id", "title", "org_title", F.array_join("tags", ",").alias("tags"), "update_frequency", "metadata_modified",
        "maintainer_en", "license_title", "resource_id", "format", "size", "last_modified")


HUB_KIND = "CASE p_size % 4 WHEN 0 THEN 'Feature Service' WHEN 1 THEN 'Map Service' WHEN 2 THEN 'CSV' ELSE '' END"
HUB_SLUG = "trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g'), '-')"


@LANDING.query("normalize_hub", f"""
SELECT concat('i', p_partkey, CASE WHEN p_size % 4 < 2 THEN '_0' ELSE '' END) AS id, {HUB_SLUG} AS name, p_name || ' (' || p_brand || ')' AS title,
 CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'short' ELSE '' END AS notes, 'City of B' AS organization, p_type AS tags, 'unknown' AS update_frequency,
 CASE WHEN p_size > 10 THEN CASE {HUB_KIND} WHEN '' THEN 'Feature Service' ELSE {HUB_KIND} END END AS format, CASE WHEN p_size > 10 THEN 1 ELSE 0 END AS n_files FROM part""")
def normalize_hub(t):
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "Feature Service").when(size % 4 == 1, "Map Service").when(size % 4 == 2, "CSV").otherwise("")
    features = t.part.select(
        F.concat(F.lit("i"), "p_partkey").alias("id"),
        F.struct(
            F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("i"), "p_partkey")).alias("id"),
            F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"),
            F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("").alias("description"),
            F.when(F.col("p_partkey") % 3 == 1, "short").alias("snippet"),
            F.array("p_type").alias("tags"), kind.alias("type"), F.when(size > 10, "http://example.com/x").otherwise("").alias("url"),
        ).alias("properties"))
    rows = normalize_hub_catalog(features, "city-b", "City of B")
    return rows.select(
        "id", "name", "title", "notes", F.col("organization.title").alias("organization"), F.array_join("tags", ",").alias("tags"),
        "update_frequency", F.get("resources", F.lit(0))["format"].alias("format"), F.size("resources").alias("n_files"))


@LANDING.query("normalize_hub_v3", f"""
SELECT concat('i', p_partkey, '_0') AS id, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') ELSE {HUB_SLUG} END AS name, p_type AS notes,
 CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE 'weekly' END AS update_frequency, '2020-01-01' AS metadata_created, 'Open' AS license_title,
 'City of B' AS geographic_coverage, 'Feature Service' AS format FROM part""")
def normalize_hub_v3(t):
    size = F.col("p_size")
    attributes = F.struct(
        F.concat(F.lit("i"), "p_partkey", F.lit("_0")).alias("id"), F.when(size % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"),
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"), F.col("p_type").alias("description"),
        F.when(size % 3 != 0, "weekly").otherwise("").alias("updateFrequency"), F.lit("2020-01-01").alias("created"),
        F.lit("Open").alias("license"), F.lit("http://example.com/x").alias("url"))
    rows = normalize_hub_record(t.part.select(F.struct(attributes.alias("attributes")).alias("data")), "city-b", "City of B")
    return rows.select(
        "id", "name", "notes", "update_frequency", "metadata_created", "license_title", "geographic_coverage",
        F.get("resources", F.lit(0))["format"].alias("format"))


@LANDING.query("metadata_json_roundtrip", f"""
SELECT id AS dataset_id, title, org_title, tags[1] AS first_tag, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'revised' ELSE license_title END AS license_title FROM {DATASETS}""")
def metadata_json_roundtrip(t):
    """Records stored as JSON, a third of them stored again; the newest text is read back."""
    store = Store(t.spark, work_dir(t.spark, "metadata"))
    d = datasets(t)
    store.put_metadata(d)
    store.put_metadata(d.where(F.col("id").cast("long") % 3 == 0).withColumn("license_title", F.lit("revised")))
    text = F.col("metadata")
    return store.metadata().select(
        "dataset_id", *[F.get_json_object(text, f"$.{c}").alias(c) for c in ("title", "org_title", "license_title")],
        F.get_json_object(text, "$.tags[0]").alias("first_tag"))


@LANDING.query("repair_landed", f"SELECT id, TRY_CAST(REPLACE(comma_text, ',', '') AS DOUBLE) AS comma_text, TRY_CAST(trim(padded_text) AS DOUBLE) AS padded_text FROM {MESSY}")
def repair_landed(t):
    """Numbers kept as text, landed in the store with the repair that landing does."""
    store = Store(t.spark, work_dir(t.spark, "repair"))
    store.land(messy(t).select("id", "comma_text", "padded_text"), "m-1", "d-1", "ds_province_messy_m-1")
    return store.table("m-1")


@LANDING.query("refresh_incremental", """
SELECT run, table_name, status, rows_added FROM (
 SELECT 1 AS run, 'orders' AS table_name, 'refreshed' AS status, COUNT(*) FILTER (WHERE o_orderkey % 2 = 0) AS rows_added FROM orders
 UNION ALL SELECT 2, 'orders', 'refreshed', COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) FROM orders
 UNION ALL SELECT 1, 'customer', 'refreshed', COUNT(*) FROM customer UNION ALL SELECT 2, 'customer', 'refreshed', 0
 UNION ALL SELECT 1, 'gone', 'error', 0 UNION ALL SELECT 2, 'gone', 'error', 0
 UNION ALL SELECT 3, 'orders', 'whole', COUNT(*) FROM orders UNION ALL SELECT 3, 'customer', 'whole', COUNT(DISTINCT c_custkey) FROM customer)""")
def incremental(t):
    """Orders arrive in two steps, customers in one, and a third folder does not exist; what each refresh adds, and the tables at the end."""
    root, inbox = work_dir(t.spark, "grown"), work_dir(t.spark, "inbox")
    sources = [Growing("orders", f"{inbox}/orders", "o_orderkey long, o_orderstatus string"), Growing("customer", f"{inbox}/customer", "c_custkey long"), Growing("gone", f"{inbox}/gone", "a int")]
    t.customer.select("c_custkey").write.parquet(f"{inbox}/customer")
    runs = []
    for step in range(2):
        t.orders.where(F.col("o_orderkey") % 2 == step).select("o_orderkey", "o_orderstatus").write.mode("append").parquet(f"{inbox}/orders")
        runs.append(refresh_incremental(t.spark, root, sources).select(F.lit(step + 1).alias("run"), "table_name", "status", "rows_added"))
    for source, key in zip(sources, ("o_orderkey", "c_custkey")):
        whole = read_growing(t.spark, root, source).agg(F.countDistinct(key).alias("rows_added"))
        runs.append(whole.select(F.lit(3).alias("run"), F.lit(source.table_name).alias("table_name"), F.lit("whole").alias("status"), "rows_added"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])
