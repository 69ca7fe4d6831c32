"""Registry, staleness, naming and id queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.functions.names import bare_id, id_portal, infer_portal, table_name
from civiclake.operators import registry as reg
from civiclake.operators.staleness import with_expiry, with_staleness
from civiclake.plans.fixtures import BARE_REQUESTS, NOW, REGISTRY, REQUESTS, portal_of, portal_sql, registry, requests
from civiclake.plans.suite import Suite
from civiclake.session import work_dir
from civiclake.sources.store import Store

REGISTRIES = Suite()

STALE = f"""(SELECT *, CASE WHEN downloaded_at IS NULL THEN NULL ELSE COALESCE(expires_at, downloaded_at + INTERVAL 30 DAY) END AS due,
 TIMESTAMP '{NOW}' > COALESCE(expires_at, downloaded_at + INTERVAL 30 DAY) AS is_stale FROM {REGISTRY})"""


@REGISTRIES.query("registry_list", f"""
SELECT resource_id, dataset_id, table_name, downloaded_at, row_count, size_bytes, source_url FROM {REGISTRY} ORDER BY downloaded_at DESC""")
def registry_list(t):
    return reg.list_registry(registry(t))


@REGISTRIES.query("registry_stats", f"""
SELECT COUNT(*) AS table_count, CAST(SUM(row_count) AS BIGINT) AS total_rows, CAST(SUM(size_bytes) AS BIGINT) AS total_size_bytes,
 ROUND(SUM(size_bytes) / 1048576, 2) AS total_size_mb FROM {REGISTRY}""")
def registry_stats(t):
    return reg.registry_stats(registry(t))


@REGISTRIES.query("registry_lookup", f"""
SELECT r.request, g.table_name, g.row_count, g.table_name IS NOT NULL AS is_landed FROM
(SELECT request, CASE WHEN request LIKE 'urn:%' THEN request ELSE split_part(request, ':', -1) END AS resource_id FROM {REQUESTS}) r
LEFT JOIN {REGISTRY} g USING (resource_id)""")
def registry_lookup(t):
    return reg.lookup_resources(requests(t), registry(t)).select("request", "table_name", "row_count", "is_landed")


@REGISTRIES.query("registry_by_tables", f"""
SELECT resource_id, dataset_id, table_name, downloaded_at, row_count, expires_at FROM {REGISTRY}
WHERE table_name IN (SELECT concat('ds_province_t_', l_orderkey) FROM lineitem WHERE l_quantity = 50)""")
def registry_by_tables(t):
    names = t.lineitem.where(F.col("l_quantity") == 50).select(F.concat(F.lit("ds_province_t_"), "l_orderkey").alias("table_name"))
    return reg.registry_by_tables(names, registry(t))


@REGISTRIES.query("registry_upsert", f"""
SELECT resource_id, row_count, downloaded_at FROM {REGISTRY} WHERE resource_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 7, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT concat('new-', c_custkey), 1, TIMESTAMP '{NOW}' FROM customer""")
def registry_upsert(t):
    """Orders still pending were landed again, and every customer brought a new table."""
    current = registry(t).select("resource_id", "row_count", "downloaded_at")
    again = t.orders.where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").cast("string").alias("resource_id"), F.lit(7).cast("long").alias("row_count"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("downloaded_at"))
    new = t.customer.select(
        F.concat(F.lit("new-"), "c_custkey").alias("resource_id"), F.lit(1).cast("long").alias("row_count"),
        F.lit(NOW).cast("timestamp_ntz").alias("downloaded_at"))
    return reg.upsert(current, again.unionByName(new))


@REGISTRIES.query("registry_landed", """
SELECT 'r-orders' AS resource_id, 'ds_province_orders_r-orders' AS table_name, COUNT(*) AS row_count, 0::BIGINT AS mismatched FROM orders
UNION ALL SELECT 'r-customer', 'ds_city_a_customer_r-custom', COUNT(*), 0 FROM customer""")
def registry_landed(t):
    """Two tables stored, one of them twice; the registry read back and checked against the files."""
    store = Store(t.spark, work_dir(t.spark, "store"))
    store.land(t.customer, "r-orders", "d1", "ds_province_orders_r-orders", repair=False)
    store.land(t.orders, "r-orders", "d1", "ds_province_orders_r-orders", repair=False)
    store.land(t.customer, "r-customer", "d2", "ds_city_a_customer_r-custom", repair=False)
    counted = store.table("r-orders").agg(F.count(F.lit(1)).alias("n")).withColumn("resource_id", F.lit("r-orders")).unionByName(
        store.table("r-customer").agg(F.count(F.lit(1)).alias("n")).withColumn("resource_id", F.lit("r-customer")))
    return store.registry().join(counted, "resource_id").select(
        "resource_id", "table_name", "row_count", (F.col("row_count") - F.col("n")).alias("mismatched"))


@REGISTRIES.query("registry_remove", f"""
SELECT resource_id, table_name FROM {REGISTRY} WHERE resource_id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.06)""")
def registry_remove(t):
    gone = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06)).select(
        F.col("l_orderkey").cast("string").alias("resource_id"))
    return reg.remove(registry(t), gone).select("resource_id", "table_name")


@REGISTRIES.query("registry_inventory", f"""
SELECT resource_id, table_name, row_count, ROUND(size_bytes / 1048576, 2) AS size_mb, due AS expires_at, is_stale FROM {STALE}""")
def registry_inventory(t):
    return reg.inventory(registry(t), NOW).select("resource_id", "table_name", "row_count", "size_mb", "expires_at", "is_stale")


@REGISTRIES.query("staleness", f"""
SELECT resource_id, downloaded_at, due AS expires_at, is_stale, ROUND(epoch(TIMESTAMP '{NOW}' - downloaded_at) / 3600, 1) AS age_hours FROM {STALE}""")
def staleness(t):
    return with_staleness(registry(t), NOW).select("resource_id", "downloaded_at", "expires_at", "is_stale", "age_hours")


@REGISTRIES.query("expires_at", f"""
SELECT resource_id, downloaded_at + to_days(CASE lower(trim(update_frequency)) WHEN 'daily' THEN 2 WHEN 'weekly' THEN 10 WHEN 'yearly' THEN 400 ELSE 30 END) AS expires_at
FROM {REGISTRY}""")
def expires_at(t):
    return with_expiry(registry(t)).select("resource_id", "expires_at")


@REGISTRIES.query("refresh_plan", f"""
SELECT resource_id, table_name, {portal_sql('CAST(resource_id AS BIGINT)')} AS portal FROM {STALE} WHERE is_stale""")
def refresh_plan(t):
    return reg.refresh_plan(registry(t), NOW).select("resource_id", "table_name", "portal")


@REGISTRIES.query("pending_resources", f"""
SELECT DISTINCT resource_id FROM {BARE_REQUESTS} WHERE resource_id NOT IN (SELECT resource_id FROM {REGISTRY})""")
def pending_resources(t):
    return reg.pending_resources(requests(t), registry(t))


@REGISTRIES.query("infer_portal", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (1, 2) THEN {portal_sql('l_orderkey')} ELSE 'province' END AS portal FROM lineitem""")
def infer(t):
    table = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("ds_"), portal_of("l_orderkey"), F.lit("_x_1")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("geo_"), portal_of("l_orderkey"), F.lit("_")))
        .when(F.col("l_linenumber") == 3, F.lit("ds_bogus_something")).otherwise(F.lit("old_cases_abc12345"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", infer_portal(table).alias("portal"))


@REGISTRIES.query("table_names", f"""
SELECT p_partkey, concat('ds_', {portal_sql('p_partkey')}, '_', substr(trim(regexp_replace(regexp_replace(lower(concat(p_brand, ' & ', p_name, ' (', p_type, ')')), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 40),
 '_', substr(concat('r-', p_partkey * 1000003), 1, 8)) AS table_name,
 concat('geo_', {portal_sql('p_partkey')}, '_geo_', substr(concat('r-', p_partkey * 1000003), 1, 8)) AS geo_table FROM part""")
def table_names(t):
    title = F.concat("p_brand", F.lit(" & "), "p_name", F.lit(" ("), "p_type", F.lit(")"))
    resource = F.concat(F.lit("r-"), F.col("p_partkey") * 1000003)
    return t.part.select(
        "p_partkey", table_name(title, resource, portal_of("p_partkey")).alias("table_name"),
        table_name(F.lit(None).cast("string"), resource, portal_of("p_partkey"), geo=True).alias("geo_table"))


@REGISTRIES.query("split_ids", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN {portal_sql('l_orderkey')} END AS portal,
 CASE WHEN l_linenumber = 2 THEN concat('urn:uuid:', l_orderkey * 2) ELSE CAST(l_orderkey * 2 AS VARCHAR) END AS bare_id FROM lineitem""")
def split_ids(t):
    key = (F.col("l_orderkey") * 2).cast("string")
    request = (
        F.when(F.col("l_linenumber") == 1, F.concat(portal_of("l_orderkey"), F.lit(":"), key))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("urn:uuid:"), key)).otherwise(key)
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", id_portal(request).alias("portal"), bare_id(request).alias("bare_id"))
