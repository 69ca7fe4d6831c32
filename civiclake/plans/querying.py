"""Structured queries and statement checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.operators import query as q
from civiclake.operators.freesql import run_sql, truncation_report
from civiclake.plans.fixtures import LOG_KIND, NOW, REGISTRY, STATEMENTS, query_log, registry, table_stats
from civiclake.plans.suite import Suite

QUERYING = Suite()


@QUERYING.query("query_filters", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 5000""")
def query_filters(t):
    return q.query_table(
        t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey asc", 5000)


@QUERYING.query("query_sort_page", """
SELECT * FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey LIMIT 100 OFFSET 200""")
def query_sort_page(t):
    return q.query_table(t.customer, sort="c_mktsegment desc, c_acctbal asc, c_custkey", offset=200)


@QUERYING.query("query_total", "SELECT COUNT(*) AS total FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2)")
def query_total(t):
    return q.query_total(t.lineitem, {"l_returnflag": "R", "l_linenumber": [1, 2]})


@QUERYING.query("preview", "SELECT * FROM events ORDER BY event_id LIMIT 250")
def preview(t):
    return q.preview(t.events, 250, "event_id")


@QUERYING.query("describe_columns", """
WITH s AS (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5)
SELECT 's_suppkey' AS name, 'bigint' AS type, string_agg(CAST(s_suppkey AS VARCHAR), '|' ORDER BY s_suppkey) AS samples FROM s
UNION ALL SELECT 's_name', 'string', string_agg(s_name, '|' ORDER BY s_suppkey) FROM s
UNION ALL SELECT 's_nationkey', 'int', string_agg(CAST(s_nationkey AS VARCHAR), '|' ORDER BY s_suppkey) FROM s
UNION ALL SELECT 's_acctbal', 'double', string_agg(CAST(s_acctbal AS VARCHAR), '|' ORDER BY s_suppkey) FROM s""")
def describe(t):
    return q.describe_columns(t.supplier, 5, "s_suppkey").select("name", "type", F.array_join("sample_values", "|").alias("samples"))


@QUERYING.query("truncation_report", """
SELECT total, LEAST(total, 2000) AS returned, total > 2000 AS truncated FROM (SELECT COUNT(*) AS total FROM lineitem WHERE l_quantity > 25)""")
def truncation(t):
    return truncation_report(run_sql(t.register("lineitem"), 'SELECT * FROM "lineitem" WHERE l_quantity > 25', cap=None))


AUDIT = " ".join(f"WHEN {i} THEN '{verdict}'" for i, (_, verdict) in enumerate(STATEMENTS))


@QUERYING.query("audit_sql", f"SELECT o_orderkey AS query_id, CASE {LOG_KIND} {AUDIT} END AS verdict FROM orders")
def audit(t):
    return q.audit_sql(query_log(t)).select("query_id", "verdict")


@QUERYING.query("query_warnings", f"""
WITH l AS (SELECT o_orderkey AS query_id, concat('ds_province_t_', o_orderkey) AS table_name, {LOG_KIND} AS kind, o_custkey % 5 AS result_rows,
 CAST(floor(o_totalprice / 100) AS BIGINT) AS row_count, o_custkey % 2 = 0 AS has_amounts FROM orders WHERE {LOG_KIND} IN (0, 2, 4, 7, 8)),
w AS (SELECT *, 'per_row_counts' AS warning FROM l WHERE kind IN (2, 4) AND has_amounts
 UNION ALL SELECT *, 'no_rows' FROM l WHERE result_rows = 0 AND row_count > 0
 UNION ALL SELECT *, 'few_groups' FROM l WHERE kind = 4 AND result_rows BETWEEN 1 AND 3 AND row_count > 1000)
SELECT query_id, table_name, warning, CASE warning
 WHEN 'per_row_counts' THEN 'Some columns may hold counts: No_of_Exceedances, Total EV. SUM("No_of_Exceedances") may be meant instead of COUNT(*).'
 WHEN 'no_rows' THEN concat('No rows came back, but the table has ', format('{{:,}}', row_count), '. Look at the WHERE and JOIN conditions.')
 ELSE concat('Only ', result_rows, ' groups from ', format('{{:,}}', row_count), ' rows. Look at the GROUP BY columns.') END AS message FROM w""")
def warnings(t):
    return q.query_warnings(query_log(t), table_stats(t))


@QUERYING.query("provenance", f"""
WITH n AS (SELECT o_orderkey AS query_id, concat('ds_province_t_', o_orderkey) AS table_name FROM orders WHERE {LOG_KIND} IN (0, 2, 4, 7, 8))
SELECT query_id, table_name, resource_id, strftime(downloaded_at, '%Y-%m-%d %H:%M:%S') AS downloaded,
 CASE WHEN expires_at IS NULL THEN 'unknown' WHEN TIMESTAMP '{NOW}' > expires_at THEN 'stale' ELSE 'fresh' END AS status
FROM n JOIN {REGISTRY} USING (table_name)""")
def provenance(t):
    return q.provenance(query_log(t), registry(t), NOW)
