"""Catalogue queries: search, facets, organizations, topics, relations, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.operators import catalog as cat
from civiclake.operators.search_index import search_ranked, write_index
from civiclake.operators.staleness import check_freshness
from civiclake.plans.fixtures import DATASETS, NOW, RESOURCES, datasets, portal_of, portal_sql, resources
from civiclake.plans.suite import Suite
from civiclake.portals import portals_frame
from civiclake.session import work_dir

CATALOGS = Suite()

RANK = "CASE portal WHEN 'province' THEN 1 WHEN 'city_a' THEN 2 ELSE 3 END"
TEXT = "lower(concat_ws(' ', title, notes, array_to_string(tags, ' ')))"
FILES = """(SELECT portal, package_id AS id, COUNT(*) AS num_resources, array_to_string(list_sort(list_distinct(list(upper(format)))), ',') AS formats
 FROM r GROUP BY 1, 2)"""


def joined(df):
    """Arrays as comma-separated text, for comparison."""
    return df.withColumns({n: F.array_join(n, ",") for n, k in df.dtypes if k == "array<string>"})


def search_sql(score: str, where: str, k: int) -> str:
    return f"""WITH d AS {DATASETS}, r AS {RESOURCES},
s AS (SELECT *, {score} AS score FROM d WHERE {where}),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portal ORDER BY score DESC, metadata_modified DESC NULLS LAST, id) AS place,
 COUNT(*) OVER (PARTITION BY portal) AS total_count FROM s WHERE score > 0 OR {score} IS NULL)
SELECT concat(p.portal, ':', p.id) AS id, p.portal, p.title, org_title AS organization, substr(notes, 1, 200) AS description,
 COALESCE(formats, '') AS formats, COALESCE(num_resources, 0) AS num_resources, metadata_modified AS last_modified,
 COALESCE(update_frequency, 'unknown') AS update_frequency, score, CAST(place AS INTEGER) AS place, total_count, LEAST(total_count, {k}) AS returned
FROM p LEFT JOIN {FILES} f ON p.portal = f.portal AND p.id = f.id WHERE place <= {k}"""


def word_score(*words):
    return " + ".join(f"CASE WHEN contains({TEXT}, '{w}') THEN 1 ELSE 0 END" for w in words)


@CATALOGS.query("search_datasets", search_sql(word_score("red", "ring", "promo"), "true", 25))
def search(t):
    return joined(cat.search_datasets(datasets(t), resources(t), "red Ring PROMO", limit=25)).drop("name")


@CATALOGS.query("search_filters", search_sql(
    word_score("brand"), "org_name = 'brand#12' AND update_frequency = 'daily' AND EXISTS (SELECT 1 FROM r WHERE r.portal = d.portal AND r.package_id = d.id AND upper(r.format) = 'CSV')", 80))
def search_filters(t):
    return joined(cat.search_datasets(
        datasets(t), resources(t), "brand", limit=80, organization="brand#12", resource_format="CSV", update_frequency="daily")).drop("name")


@CATALOGS.query("catalog_summary_cols", f"""
WITH d AS {DATASETS}, r AS {RESOURCES}
SELECT concat(d.portal, ':', d.id) AS id, d.portal, d.name, title, org_title AS organization, substr(notes, 1, 200) AS description, COALESCE(formats, '') AS formats,
 COALESCE(num_resources, 0) AS num_resources, metadata_modified AS last_modified, COALESCE(update_frequency, 'unknown') AS update_frequency
FROM d LEFT JOIN {FILES} f ON d.portal = f.portal AND d.id = f.id""")
def catalog_summary_cols(t):
    return joined(cat.summary_columns(datasets(t), resources(t)))


@CATALOGS.query("catalog_page", f"""
SELECT portal, id, title, metadata_modified FROM {DATASETS} ORDER BY title DESC, portal, id LIMIT 40 OFFSET 60""")
def catalog_page(t):
    return cat.catalog_page(datasets(t), start=60, rows=40, sort="title desc").select("portal", "id", "title", "metadata_modified")


@CATALOGS.query("facet_counts", f"""
WITH d AS {DATASETS} SELECT 'org_name' AS facet, org_name AS value, COUNT(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'update_frequency', update_frequency, COUNT(*) FROM d WHERE update_frequency IS NOT NULL GROUP BY 2
UNION ALL SELECT 'portal', portal, COUNT(*) FROM d GROUP BY 2""")
def facets(t):
    return cat.facet_counts(datasets(t), ["org_name", "update_frequency", "portal"])


@CATALOGS.query("search_resources", f"""
SELECT id, package_id, format, size FROM {RESOURCES} WHERE lower(format) LIKE '%json%' AND name LIKE '%99%' ORDER BY size DESC, portal, id, package_id LIMIT 100 OFFSET 5""")
def search_resources(t):
    return cat.search_resources(resources(t), ["format:json", "name:99"], "size desc", limit=100, offset=5).select("id", "package_id", "format", "size")


@CATALOGS.query("list_organizations", f"""
SELECT portal, org_name AS name, MAX(org_title) AS title, COUNT(*) AS dataset_count, '' AS description FROM {DATASETS} GROUP BY portal, org_name""")
def organizations(t):
    return cat.list_organizations(datasets(t))


@CATALOGS.query("list_topics", f"""
WITH c AS (SELECT portal, name, COUNT(*) AS n FROM (SELECT DISTINCT portal, id, unnest(tags) AS name FROM {DATASETS}) WHERE contains(name, 'e') GROUP BY portal, name)
SELECT portal, name, n, (SELECT COUNT(*) FROM c) AS total FROM c ORDER BY n DESC, {RANK}, name LIMIT 20""")
def topics(t):
    return cat.list_topics(datasets(t), query="E", limit=20)


@CATALOGS.query("related_datasets", f"""
WITH d AS {DATASETS},
tagged AS (SELECT DISTINCT portal, id, metadata_modified, unnest(tags) AS tag FROM d),
pairs AS (SELECT s.portal, s.id AS source_id, c.id, c.metadata_modified, 0 AS step FROM (SELECT portal, id, unnest(list_distinct(tags)) AS tag FROM d) s
 JOIN tagged c ON s.portal = c.portal AND s.tag = c.tag AND s.id != c.id
 UNION ALL SELECT s.portal, s.id, c.id, c.metadata_modified, 1 FROM d s JOIN d c ON s.portal = c.portal AND s.org_name = c.org_name AND s.id != c.id),
best AS (SELECT portal, source_id, id, metadata_modified, MIN(step) AS step FROM pairs GROUP BY ALL),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portal, source_id ORDER BY step, metadata_modified DESC NULLS LAST, id) AS place FROM best)
SELECT concat(p.portal, ':', source_id) AS source_id, CAST(place AS INTEGER) AS place, concat(p.portal, ':', p.id) AS id, c.title, c.org_title AS organization,
 CASE step WHEN 0 THEN array_to_string(list_sort(list_distinct(list_intersect(c.tags, s.tags))), ',') ELSE '' END AS shared_tags,
 CASE step WHEN 0 THEN 'tags' ELSE 'same_organization' END AS relevance
FROM placed p JOIN d c ON p.portal = c.portal AND p.id = c.id JOIN d s ON p.portal = s.portal AND p.source_id = s.id WHERE place <= 5""")
def related(t):
    """Related datasets of every dataset at once."""
    found = cat.related_datasets(datasets(t), limit=5)
    return joined(found.withColumn("shared_tags", F.array_sort("shared_tags")))


@CATALOGS.query("list_portals", f"""
SELECT portal, CASE portal WHEN 'province' THEN 'Province Open Data' WHEN 'city_a' THEN 'City A Open Data' ELSE 'City B Open Data' END AS name,
 CASE portal WHEN 'city_b' THEN 'arcgis_hub' ELSE 'ckan' END AS portal_type, COUNT(*) AS n_datasets FROM {DATASETS} GROUP BY portal""")
def list_portals(t):
    """The portals, with how much of the catalogue each holds."""
    counted = datasets(t).groupBy("portal").agg(F.count(F.lit(1)).alias("n_datasets"))
    return portals_frame(t.spark).join(counted, "portal").select("portal", "name", "portal_type", "n_datasets")


@CATALOGS.query("dataset_info", f"""
SELECT concat(portal, ':', id) AS id, name, title, notes AS description, org_title AS organization, COALESCE(NULLIF(maintainer_en, ''), maintainer) AS maintainer,
 license_title AS license, array_to_string(tags, ',') AS tags, update_frequency, CAST(NULL AS VARCHAR) AS created, metadata_modified AS last_modified, 'open' AS access_level,
 CAST(NULL AS VARCHAR) AS geographic_coverage FROM {DATASETS}""")
def dataset_info(t):
    return joined(cat.dataset_info(datasets(t)))


@CATALOGS.query("list_resources", f"""
SELECT concat(portal, ':', package_id) AS dataset_id, id, name, format, size AS size_bytes, CAST(NULL AS VARCHAR) AS url, last_modified, datastore_active,
 concat(COALESCE(data_range_start, '?'), ' to ', COALESCE(data_range_end, '?')) AS data_range FROM {RESOURCES}""")
def list_resources(t):
    return cat.list_resources(resources(t))


@CATALOGS.query("portal_stats", f"""
WITH d AS {DATASETS}, o AS (SELECT portal, org_name, MAX(org_title) AS organization, COUNT(*) AS datasets FROM d GROUP BY 1, 2),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portal ORDER BY datasets DESC, org_name) AS place FROM o)
SELECT portal, CAST(SUM(datasets) OVER (PARTITION BY portal) AS BIGINT) AS total_datasets, organization, datasets, CAST(place AS INTEGER) AS place FROM p QUALIFY place <= 5""".replace(
    "CAST(SUM(datasets) OVER (PARTITION BY portal) AS BIGINT)", "(SELECT COUNT(*) FROM d WHERE d.portal = p.portal)").replace(" QUALIFY", " WHERE"))
def portal_stats(t):
    return cat.portal_stats(datasets(t), portals_frame(t.spark)).drop("name")


@CATALOGS.query("compare_datasets", f"""
WITH d AS {DATASETS}, r AS {RESOURCES}, c AS (SELECT * FROM d WHERE id IN ('0', '1', '2', '64', '129', '500'))
SELECT concat(c.portal, ':', c.id) AS id, title, org_title AS organization, COALESCE(num_resources, 0) AS num_resources, formats, update_frequency,
 metadata_modified AS last_modified, array_to_string(tags, ',') AS tags, license_title AS license, CAST(NULL AS VARCHAR) AS geographic_coverage,
 (SELECT COALESCE(string_agg(tag, ',' ORDER BY tag), '') FROM (SELECT tag FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM c) GROUP BY tag HAVING COUNT(*) = (SELECT COUNT(*) FROM c))) AS shared_tags
FROM c LEFT JOIN {FILES} f ON c.portal = f.portal AND c.id = f.id""")
def compare(t):
    """Six chosen datasets: choosing is the operator."""
    return joined(cat.compare_datasets(datasets(t), resources(t), ["province:0", "1", "city_b:2", "64", "129", "500"]))


@CATALOGS.query("shared_tags", f"""
WITH d AS {DATASETS}, g AS (SELECT title, COUNT(*) AS n_datasets FROM d GROUP BY title)
SELECT title, tag, n_datasets FROM (SELECT title, tag, COUNT(*) AS n FROM (SELECT DISTINCT title, portal, id, unnest(tags) AS tag FROM d) GROUP BY 1, 2) JOIN g USING (title)
WHERE n = n_datasets""")
def shared(t):
    return cat.shared_tags(datasets(t), ["title"])


@CATALOGS.query("resolve_ids", f"""
WITH c AS (SELECT DISTINCT CAST(p_partkey // 2 AS VARCHAR) AS id, {portal_sql('p_partkey')} AS portal FROM part),
q AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS bare_id, CASE WHEN l_linenumber <= 3 THEN {portal_sql('l_linenumber')} END AS wanted FROM lineitem),
h AS (SELECT id, MIN({RANK}) AS best, list(portal) AS homes FROM c GROUP BY id)
SELECT concat(COALESCE(wanted || ':', ''), bare_id) AS request, bare_id,
 CASE WHEN wanted IS NULL THEN CASE best WHEN 1 THEN 'province' WHEN 2 THEN 'city_a' WHEN 3 THEN 'city_b' END WHEN list_contains(homes, wanted) THEN wanted END AS portal
FROM q LEFT JOIN h ON q.bare_id = h.id""")
def resolve(t):
    known = t.part.select(F.expr("p_partkey div 2").cast("string").alias("id"), portal_of("p_partkey").alias("portal"))
    asked = t.lineitem.select(F.concat(
        F.when(F.col("l_linenumber") <= 3, F.concat(portal_of("l_linenumber"), F.lit(":"))).otherwise(""),
        F.col("l_partkey").cast("string")).alias("request"))
    return cat.resolve_ids(asked, known).select("request", "bare_id", "portal")


@CATALOGS.query("list_geo_datasets", f"""
WITH d AS {DATASETS}, r AS {RESOURCES},
f AS (SELECT d.portal, d.id, metadata_modified, geo_format FROM d JOIN (SELECT DISTINCT portal, package_id, upper(format) AS geo_format FROM r WHERE upper(format) IN ('SHP', 'KML', 'GEOJSON')) x
 ON d.portal = x.portal AND d.id = x.package_id),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY portal, geo_format ORDER BY metadata_modified DESC NULLS LAST, id) AS place FROM f),
u AS (SELECT portal, id, MIN(CASE geo_format WHEN 'SHP' THEN 1000 WHEN 'KML' THEN 2000 ELSE 3000 END + place) AS spot FROM p WHERE place <= 130 GROUP BY portal, id ORDER BY {RANK}, spot, id LIMIT 130)
SELECT concat(d.portal, ':', d.id) AS id, d.title, d.org_title AS organization, r.id AS resource_id, r.name AS resource_name, r.format, r.size
FROM d JOIN u ON d.portal = u.portal AND d.id = u.id LEFT JOIN r ON r.portal = d.portal AND r.package_id = d.id AND upper(r.format) IN ('SHP', 'KML', 'GEOJSON', 'ZIP')""")
def geo_datasets(t):
    return cat.list_geo_datasets(datasets(t), resources(t), limit=130)


@CATALOGS.query("check_freshness", f"""
SELECT portal, id, title, update_frequency, metadata_modified AS last_modified, CAST(NULL AS VARCHAR) AS current_as_of,
 CAST(floor(epoch(TIMESTAMP '{NOW}' - CAST(metadata_modified AS TIMESTAMP)) / 86400) AS BIGINT) AS days_since_update,
 floor(epoch(TIMESTAMP '{NOW}' - CAST(metadata_modified AS TIMESTAMP)) / 86400) > CASE update_frequency WHEN 'daily' THEN 2 WHEN 'weekly' THEN 10 WHEN 'yearly' THEN 400 END AS is_stale
FROM {DATASETS}""")
def freshness(t):
    return check_freshness(datasets(t), NOW)


@CATALOGS.query("search_ranked", f"""
WITH d AS (SELECT portal, id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, notes, array_to_string(tags, ' '))), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM {DATASETS}),
s AS (SELECT portal, COUNT(*) AS n, AVG(len(words)) AS mean_length FROM d GROUP BY portal),
p AS (SELECT portal, id, word, COUNT(*) AS t, any_value(length) AS length FROM (SELECT portal, id, len(words) AS length, unnest(words) AS word FROM d)
 WHERE word IN ('large', 'gear', 'red', 'brand', '7') GROUP BY ALL),
w AS (SELECT portal, word, ln(1 + (n - c + 0.5::DOUBLE) / (c + 0.5::DOUBLE)) AS weight, mean_length FROM (SELECT portal, word, COUNT(*) AS c FROM p GROUP BY ALL) JOIN s USING (portal)),
r AS (SELECT portal, id, ROUND(SUM(weight * t * 2.2::DOUBLE / (t + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score, COUNT(*) AS words_found
 FROM p JOIN w USING (portal, word) GROUP BY portal, id)
SELECT portal, CAST(place AS INTEGER) AS place, id, score, CAST(words_found AS INTEGER) AS words_found
FROM (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY score DESC, id) AS place FROM r) WHERE place <= 10""")
def ranked(t):
    """The ten best datasets of each portal for a query of five words, from an index in the work folder."""
    folder = work_dir(t.spark, "index")
    write_index(datasets(t), folder)
    return search_ranked(t.spark, folder, "large RED gear, brand#7")
