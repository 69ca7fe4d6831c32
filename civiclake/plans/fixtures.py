"""Open-data shapes derived from the given tables, as DataFrames and as SQL.

The catalogue, its files, the registry of landed tables, numbers kept as text,
geometry text, claims and logged statements all grow with the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.session import Tables

NOW = "2001-09-01 00:00:00"


def portal_of(key: str):
    return F.element_at(F.array(F.lit("province"), F.lit("city_a"), F.lit("city_b")), (F.col(key) % 3 + 1).cast("int"))


def portal_sql(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN 'province' WHEN 1 THEN 'city_a' ELSE 'city_b' END"


# --- numbers kept as text -------------------------------------------------------

def messy(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") == 1, "N/A").otherwise(size).alias("plain_text"),
        F.concat(size, F.lit(",000")).alias("comma_text"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("x"), size)).otherwise(size).alias("edge_text"),
        F.when(F.col("p_size") <= 25, F.concat(F.lit(" "), size, F.lit(".5 "))).alias("padded_text"),
        F.col("p_brand").alias("label"),
    )


MESSY = """(SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN 'N/A' ELSE CAST(p_size AS VARCHAR) END AS plain_text,
 concat(p_size, ',000') AS comma_text, CASE WHEN p_size % 5 = 0 THEN concat('x', p_size) ELSE CAST(p_size AS VARCHAR) END AS edge_text,
 CASE WHEN p_size > 25 THEN NULL ELSE concat(' ', p_size, '.5 ') END AS padded_text, p_brand AS label FROM part)"""


def dup_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_partkey", "l_linenumber", "l_returnflag", F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("q"))


DUP_ROWS = """(SELECT l_partkey, l_linenumber, l_returnflag, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q FROM lineitem)"""


# --- registry of landed tables ----------------------------------------------------

def registry(t: Tables) -> DataFrame:
    """One landed table per order."""
    key = F.col("o_orderkey").cast("string")
    landed = F.col("o_orderdate")
    whole = F.floor("o_totalprice").cast("long")
    return t.orders.select(
        key.alias("resource_id"),
        F.col("o_custkey").cast("string").alias("dataset_id"),
        F.concat(F.lit("ds_"), portal_of("o_orderkey"), F.lit("_t_"), key).alias("table_name"),
        landed.alias("downloaded_at"),
        whole.alias("row_count"),
        (whole * 64).alias("size_bytes"),
        F.concat(F.lit("http://example.com/"), key, F.lit(".csv")).alias("source_url"),
        F.when(F.col("o_orderstatus") != "F", landed + F.make_dt_interval(F.lit(400))).alias("expires_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "daily").when(F.col("o_orderpriority") == "2-HIGH", " Weekly")
        .when(F.col("o_orderpriority") != "5-LOW", "yearly").alias("update_frequency"),
    )


REGISTRY = f"""(SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey AS VARCHAR) AS dataset_id,
 concat('ds_', {portal_sql('o_orderkey')}, '_t_', o_orderkey) AS table_name, o_orderdate AS downloaded_at,
 CAST(floor(o_totalprice) AS BIGINT) AS row_count, CAST(floor(o_totalprice) AS BIGINT) * 64 AS size_bytes,
 concat('http://example.com/', o_orderkey, '.csv') AS source_url,
 CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate + INTERVAL 400 DAY END AS expires_at,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN ' Weekly' WHEN '5-LOW' THEN NULL ELSE 'yearly' END AS update_frequency
 FROM orders)"""


def requests(t: Tables) -> DataFrame:
    """Resource ids asked for: with the right prefix, a strange prefix or none; many repeat or do not exist."""
    key = (F.col("l_orderkey") * 2).cast("string")
    return t.lineitem.select(
        F.when(F.col("l_linenumber") == 1, F.concat(portal_of("l_orderkey"), F.lit(":"), key))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("urn:uuid:"), key)).otherwise(key).alias("request")
    )


REQUESTS = f"""(SELECT CASE l_linenumber WHEN 1 THEN concat({portal_sql('l_orderkey')}, ':', l_orderkey * 2)
 WHEN 2 THEN concat('urn:uuid:', l_orderkey * 2) ELSE CAST(l_orderkey * 2 AS VARCHAR) END AS request FROM lineitem)"""

# The same rows with the prefix taken off, without a pattern.
BARE_REQUESTS = """(SELECT CASE l_linenumber WHEN 2 THEN concat('urn:uuid:', l_orderkey * 2) ELSE CAST(l_orderkey * 2 AS VARCHAR) END AS resource_id,
 l_linenumber FROM lineitem)"""


# --- catalogue ------------------------------------------------------------------------

def datasets(t: Tables) -> DataFrame:
    """One dataset per part; its last change is the part's last shipment."""
    changed = t.lineitem.groupBy("l_partkey").agg(F.max("l_shipdate").alias("changed"))
    kind = F.col("p_type")
    word = (
        F.when(kind == "STANDARD", "daily").when(kind == "ECONOMY", "Monthly")
        .when(kind == "MEDIUM", "yearly").when(kind == "PROMO", "weekly")
    )
    none = F.lit(None).cast("string")
    return t.part.join(changed, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        portal_of("p_partkey").alias("portal"),
        F.col("p_partkey").cast("string").alias("id"),
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("notes"),
        F.lower("p_brand").alias("org_name"),
        F.col("p_brand").alias("org_title"),
        F.array_append(F.split("p_name", " "), F.lower("p_type")).alias("tags"),
        word.alias("update_frequency"),
        F.date_format("changed", "yyyy-MM-dd'T'HH:mm:ss").alias("metadata_modified"),
        none.alias("metadata_created"),
        kind.alias("license_title"),
        none.alias("geographic_coverage"),
        F.col("p_brand").alias("maintainer"),
        F.when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 4 != 0, F.concat(F.lit("m"), "p_size")).alias("maintainer_en"),
        F.lit("open").alias("access_level"),
        none.alias("current_as_of"),
    )


DATASETS = f"""(SELECT {portal_sql('p_partkey')} AS portal, CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', '-') AS name, p_name AS title,
 concat(p_brand, ' ', p_type, ' ', p_name) AS notes, lower(p_brand) AS org_name, p_brand AS org_title,
 list_append(string_split(p_name, ' '), lower(p_type)) AS tags,
 CASE p_type WHEN 'STANDARD' THEN 'daily' WHEN 'ECONOMY' THEN 'Monthly' WHEN 'MEDIUM' THEN 'yearly' WHEN 'PROMO' THEN 'weekly' END AS update_frequency,
 strftime(m.changed, '%Y-%m-%dT%H:%M:%S') AS metadata_modified, p_type AS license_title, p_brand AS maintainer,
 CASE p_size % 4 WHEN 1 THEN '' WHEN 0 THEN NULL ELSE concat('m', p_size) END AS maintainer_en
 FROM part LEFT JOIN (SELECT l_partkey, MAX(l_shipdate) AS changed FROM lineitem GROUP BY l_partkey) m ON p_partkey = m.l_partkey)"""


def resources(t: Tables) -> DataFrame:
    """One file per (order, line, part)."""
    none = F.lit(None).cast("string")
    flag = F.min("l_returnflag")
    return (
        t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(
            F.when(flag == "A", "csv").when(flag == "N", "GeoJSON").otherwise("SHP").alias("format"),
            (F.floor(F.sum("l_quantity")).cast("long") * 1024).alias("size"),
            (F.min("l_linestatus") == "O").alias("datastore_active"),
            F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_modified"),
        )
        .select(
            portal_of("l_partkey").alias("portal"), F.col("l_partkey").cast("string").alias("package_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
            F.concat(F.lit("file "), "l_orderkey").alias("name"), "format", "size", none.alias("url"), "last_modified",
            "datastore_active", F.when(F.col("l_linenumber") > 2, F.col("last_modified")).alias("data_range_start"),
            F.when(F.col("l_linenumber") < 6, F.lit("2001-12-31")).alias("data_range_end"),
        )
    )


RESOURCES = f"""(SELECT *, CASE WHEN l_linenumber > 2 THEN last_modified END AS data_range_start, CASE WHEN l_linenumber < 6 THEN '2001-12-31' END AS data_range_end
 FROM (SELECT {portal_sql('l_partkey')} AS portal, CAST(l_partkey AS VARCHAR) AS package_id, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS id,
 l_linenumber, concat('file ', l_orderkey) AS name, CASE MIN(l_returnflag) WHEN 'A' THEN 'csv' WHEN 'N' THEN 'GeoJSON' ELSE 'SHP' END AS format,
 CAST(floor(SUM(l_quantity)) AS BIGINT) * 1024 AS size, MIN(l_linestatus) = 'O' AS datastore_active,
 strftime(MAX(l_shipdate), '%Y-%m-%d') AS last_modified FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey))"""


# --- logged statements --------------------------------------------------------------------

# What kind of statement each log row holds, by order key; {t} is the order's table and
# {n} the next one, which may not be landed. The verdict is what an audit must say.
STATEMENTS = (
    ("SELECT * FROM \"{t}\" WHERE note = 'a;b'", "ok"),
    ("SELECT 1; DROP TABLE \"{t}\"", "semicolons"),
    ("SELECT COUNT(*) FROM \"{t}\"", "ok"),
    ("/* harmless */ DROP TABLE \"{t}\"", "read-only"),
    ("select kind, count( * ) from \"{t}\" group  by kind", "ok"),
    ("WITH c AS (SELECT 1 AS k) SELECT * FROM c JOIN \"{t}\" USING (k)", "ok"),
    ("SELECT 1 --'\n; DROP TABLE x", "semicolons"),
    ("SELECT a.id FROM \"{t}\" a JOIN \"{n}\" b ON a.id = b.id", "ok"),
    ("SELECT 'O''Brien'; DELETE FROM \"{t}\"", "semicolons"),
    ("-- only a comment\nUPDATE \"{t}\" SET x = 1", "read-only"),
    ("", "read-only"),
)


def query_log(t: Tables) -> DataFrame:
    """One logged statement per order."""
    def name(shift: int):
        key = F.col("o_orderkey") + shift
        return F.concat(F.lit("ds_province_t_"), key.cast("string"))

    kinds = F.array(*[F.lit(text) for text, _ in STATEMENTS])
    text = F.element_at(kinds, (F.col("o_orderkey") % len(STATEMENTS) + 1).cast("int"))
    return t.orders.select(
        F.col("o_orderkey").alias("query_id"),
        F.replace(F.replace(text, F.lit("{t}"), name(0)), F.lit("{n}"), name(3)).alias("sql"),
        (F.col("o_custkey") % 5).alias("result_rows"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(10))).alias("started_at"),
    )


LOG_KIND = f"(o_orderkey % {len(STATEMENTS)})"


def table_stats(t: Tables) -> DataFrame:
    """Row count and column names of each landed table."""
    return t.orders.select(
        F.concat(F.lit("ds_province_t_"), F.col("o_orderkey").cast("string")).alias("table_name"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("row_count"),
        F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("id"), F.lit("No_of_Exceedances"), F.lit("Total EV")))
        .otherwise(F.array(F.lit("id"), F.lit("name"))).alias("columns"),
    )


# --- claims ---------------------------------------------------------------------------------

def claim_results(t: Tables) -> DataFrame:
    """Per customer one query result: a row per order status."""
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"),
    ).select(
        F.concat(F.lit("q"), "o_custkey").alias("result_id"), "o_custkey", "o_orderstatus", "n", "amount",
        (F.col("n") / 64).alias("rate"),
    )


CLAIM_RESULTS = """(SELECT concat('q', o_custkey) AS result_id, o_custkey, o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS amount, COUNT(*) / 64 AS rate
 FROM orders GROUP BY o_custkey, o_orderstatus)"""

CLAIM_KINDS = 8


def claims(t: Tables) -> DataFrame:
    """Eight claims about every result row, each with a known verdict."""
    n, status = F.col("n").cast("string"), F.col("o_orderstatus")
    texts = [
        F.concat(F.lit("There were "), n, F.lit(' orders with status "'), F.lower(status), F.lit('".')),
        F.concat(F.lit("There were "), (F.col("n") + 900000).cast("string"), F.lit(" orders.")),
        F.lit("Many orders were placed."),
        F.concat(F.lit("There were "), n, F.lit(" orders, up 98,765,432,109.5%.")),
        F.concat(F.lit("They were worth "), F.format_number(F.col("amount") + 0.25, 2), F.lit(" dollars.")),
        F.lit("Some had the status 'nope' today."),
        F.concat(F.lit("That is "), F.format_number(F.col("n") * 1.5625, 4), F.lit(" % of all.")),
        F.concat(F.lit("There were "), n, F.lit(" orders.")),
    ]
    table = F.concat(F.lit("ds_"), portal_of("o_custkey"), F.lit("_t_"), F.col("o_custkey").cast("string"))
    return claim_results(t).select(
        "result_id", "o_custkey", "o_orderstatus", F.posexplode(F.array(*texts)).alias("v", "claim")
    ).select(
        F.concat_ws("#", "result_id", "o_orderstatus", "v").alias("claim_id"), "result_id", "claim",
        F.when(F.col("v") == 7, F.concat(F.lit('DROP TABLE "'), table, F.lit('"')))
        .otherwise(F.concat(F.lit('SELECT * FROM "'), table, F.lit('"'))).alias("sql"),
        F.lit("1998-06-01").cast("timestamp_ntz").alias("started_at"),
    )


CLAIMS = f"""(SELECT concat(result_id, '#', o_orderstatus, '#', v) AS claim_id, * FROM {CLAIM_RESULTS} CROSS JOIN (SELECT unnest(range(8)) AS v))"""


# --- geometry -----------------------------------------------------------------------------

def geo_points(t: Tables) -> DataFrame:
    """One point per customer on whole degrees, some without geometry."""
    lon, lat = F.col("c_custkey") * 37 % 360 - 180, F.col("c_custkey") * 53 % 180 - 90
    return t.customer.select(
        F.col("c_custkey").alias("id"), lon.alias("lon"), lat.alias("lat"),
        F.when(F.col("c_custkey") % 50 != 0, F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")"))).alias("geometry_wkt"),
    )


GEO_POINTS = """(SELECT c_custkey AS id, (c_custkey * 37) % 360 - 180 AS lon, (c_custkey * 53) % 180 - 90 AS lat,
 CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE concat('POINT (', (c_custkey * 37) % 360 - 180, ' ', (c_custkey * 53) % 180 - 90, ')') END AS geometry_wkt FROM customer)"""


def geo_polys(t: Tables) -> DataFrame:
    """One rectangle per part, 2 by 3 up to 8 by 7 degrees, corners on whole degrees."""
    key = F.col("p_partkey")
    corners = t.part.select(
        key.alias("id"), (key * 29 % 350 - 178).alias("x0"), (key * 17 % 165 - 88).alias("y0"),
        (key % 7 + 2).alias("w"), (key % 5 + 3).alias("h"),
    ).select("id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    def at(x, y):
        return F.concat_ws(" ", x, y)

    ring = F.concat_ws(", ", at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))
    return corners.withColumn("geometry_wkt", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))


GEO_POLYS = """(SELECT *, concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') AS geometry_wkt FROM
 (SELECT p_partkey AS id, p_partkey * 29 % 350 - 178 AS x0, p_partkey * 17 % 165 - 88 AS y0,
 p_partkey * 29 % 350 - 178 + p_partkey % 7 + 2 AS x1, p_partkey * 17 % 165 - 88 + p_partkey % 5 + 3 AS y1 FROM part))"""
