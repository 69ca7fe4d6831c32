"""The SQL surface: what users can ask of landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from civiclake.operators.freesql import run_sql
from civiclake.operators.ranges import range_join
from civiclake.plans.suite import Suite
from civiclake.session import Tables

SQL = Suite()


def cents(name: str):
    """Money as whole cents: sums are exact in any order of the rows."""
    return F.round(F.col(name) * 100).cast("long")


def month_of(name: str):
    return F.trunc(F.col(name), "month")


def monthly(t: Tables) -> DataFrame:
    """Orders per customer and month. Windows run on this, not on raw rows: a
    customer has at most one row per month, however many orders there are."""
    return t.orders.groupBy("o_custkey", month_of("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("amount")
    )


MONTHLY = """(SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n,
 CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders GROUP BY 1, 2)"""


# --- reports in the style of the worked examples ---------------------------

@SQL.query("flagship_topk", """
SELECT n_name, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS total_price,
       ROUND(AVG(o_totalprice), 1) AS avg_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 0 GROUP BY n_name ORDER BY total_price DESC, n_name LIMIT 10""")
def flagship_topk(t):
    """Top ten groups by total, with count and rounded average."""
    per_customer = (
        t.orders.where(F.col("o_totalprice") > 0)
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    )
    return (
        per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("n").alias("order_count"), F.sum("total").alias("total"))
        .join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum("order_count").alias("order_count"), F.sum("total").alias("total"))
        .select(
            "n_name", "order_count", F.round("total", 2).alias("total_price"),
            F.round(F.col("total") / F.col("order_count"), 1).alias("avg_price"),
        )
        .orderBy(F.desc("total_price"), "n_name")
        .limit(10)
    )


@SQL.query("frequent_values", """
SELECT p_name, COUNT(*) AS occurrences FROM part WHERE p_name IS NOT NULL AND p_name != ''
GROUP BY p_name ORDER BY occurrences DESC, p_name LIMIT 10""")
def frequent_values(t):
    return (
        t.part.where(F.col("p_name").isNotNull() & (F.col("p_name") != ""))
        .groupBy("p_name").agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "p_name").limit(10)
    )


@SQL.query("sector_totals", """
SELECT p_brand, p_type, COUNT(*) AS n_parts, CAST(SUM(p_size) AS BIGINT) AS sizes,
       ROUND(SUM(TRY_CAST(CASE WHEN p_size = 1 THEN 'N/A' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE)), 0) AS total
FROM part GROUP BY p_brand, p_type ORDER BY total DESC""")
def sector_totals(t):
    text = F.when(F.col("p_size") == 1, F.lit("N/A")).otherwise(F.col("p_size").cast("string"))
    return (
        t.part.groupBy("p_brand", "p_type")
        .agg(
            F.count(F.lit(1)).alias("n_parts"),
            F.sum("p_size").alias("sizes"),
            F.round(F.sum(text.try_cast("double")), 0).alias("total"),
        )
        .orderBy(F.desc_nulls_last("total"))
    )


@SQL.query("status_counts", """
SELECT o_orderpriority, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total,
       CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed
FROM orders GROUP BY o_orderpriority""")
def status_counts(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("completed"),
    )


@SQL.query("share_of_total", """
SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS BIGINT) AS quantity,
       100.0::DOUBLE * SUM(l_quantity) / SUM(SUM(l_quantity)) OVER () AS share_pct
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def share_of_total(t):
    grouped = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    whole = grouped.agg(F.sum("q")).scalar()
    return grouped.select(
        "l_returnflag", "l_linestatus", F.col("q").cast("long").alias("quantity"),
        (F.lit(100.0) * F.col("q") / whole).alias("share_pct"),
    )


@SQL.query("yoy_compare", f"""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount
           FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, a.amount AS amount_1997, b.amount AS amount_1998,
       b.amount * 100.0::DOUBLE / a.amount AS ratio_pct
FROM (SELECT * FROM y WHERE y = 1997) a JOIN (SELECT * FROM y WHERE y = 1998) b USING (o_custkey)
ORDER BY ratio_pct DESC, o_custkey""")
def yoy_compare(t):
    """Two yearly tables side by side; both halves share one grouped scan per year."""
    def year(y):
        return (
            t.orders.where((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp_ntz"))
                           & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz")))
            .groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias(f"amount_{y}"))
        )

    return (
        year(1997).join(year(1998), "o_custkey")
        .withColumn("ratio_pct", F.col("amount_1998") * F.lit(100.0) / F.col("amount_1997"))
        .orderBy(F.desc("ratio_pct"), "o_custkey")
    )


# --- projection, filters ----------------------------------------------------

@SQL.query("sql_project", """
SELECT o_orderkey AS "Order Key", o_totalprice * 2 - 1 AS "Adjusted Price", upper(o_orderstatus) AS status FROM orders""")
def sql_project(t):
    return run_sql(t.register("orders"), 'SELECT o_orderkey AS "Order Key", o_totalprice * 2 - 1 AS "Adjusted Price", '
                   'upper("o_orderstatus") AS status FROM "orders"', cap=None)


@SQL.query("sql_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE (l_quantity >= 45 OR l_discount < 0.02) AND NOT l_returnflag = 'R' AND l_linestatus IS NOT NULL AND l_linestatus != ''""")
def sql_filter(t):
    return t.lineitem.where(
        ((F.col("l_quantity") >= 45) | (F.col("l_discount") < 0.02))
        & (F.col("l_returnflag") != "R") & F.col("l_linestatus").isNotNull() & (F.col("l_linestatus") != "")
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@SQL.query("sql_like", """
SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_brand LIKE 'Brand#1_' OR p_name ILIKE 'RED%'""")
def sql_like(t):
    name = F.col("p_name")
    return t.part.where(name.like("%ring%") | F.col("p_brand").like("Brand#1_") | name.ilike("RED%")).select("p_partkey", "p_name")


@SQL.query("sql_in_between", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def sql_in_between(t):
    day = F.col("o_orderdate")
    return t.orders.where(
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
        & day.between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_orderpriority")


# --- joins ------------------------------------------------------------------

@SQL.query("join_inner", """
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_inner(t):
    buyers = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")
    return t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@SQL.query("join_left", """
SELECT c_custkey, COUNT(o_orderkey) AS n_orders, MAX(o_totalprice) AS max_price
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def join_left(t):
    grouped = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("max_price"))
    return t.customer.select("c_custkey").join(grouped, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "max_price")


@SQL.query("join_right", """
SELECT s_suppkey, n FROM (SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey) l
RIGHT JOIN supplier ON l_suppkey = s_suppkey""")
def join_right(t):
    big = t.lineitem.where(F.col("l_quantity") > 49).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return big.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "right").select("s_suppkey", "n")


@SQL.query("join_full", """
SELECT COALESCE(a.l_partkey, b.l_partkey) AS partkey, a.n AS n_small, b.n AS n_large
FROM (SELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY l_partkey) a
FULL OUTER JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY l_partkey) b
ON a.l_partkey = b.l_partkey""")
def join_full(t):
    def part(where, name):
        return t.lineitem.where(where).groupBy(F.col("l_partkey").alias("partkey")).agg(F.count(F.lit(1)).alias(name))

    return part(F.col("l_quantity") < 3, "n_small").join(part(F.col("l_quantity") > 48, "n_large"), "partkey", "full")


@SQL.query("join_cross", """
SELECT o_orderstatus, n, total, n * 100.0::DOUBLE / total AS pct
FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) g CROSS JOIN (SELECT COUNT(*) AS total FROM orders) w""")
def join_cross(t):
    """CROSS JOIN in the one form that scales: against a single summary row."""
    return run_sql(t.register("orders"), """
SELECT o_orderstatus, n, total, CAST(n AS DOUBLE) * 100 / total AS pct
FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) g
CROSS JOIN (SELECT COUNT(*) AS total FROM orders) w""", cap=None)


@SQL.query("join_using", """
SELECT orderkey, l_linenumber, o_orderstatus FROM (SELECT l_orderkey AS orderkey, l_linenumber FROM lineitem WHERE l_tax = 0.08) l
JOIN (SELECT o_orderkey AS orderkey, o_orderstatus FROM orders) o USING (orderkey)""")
def join_using(t):
    return run_sql(t.register("orders", "lineitem"), """
SELECT orderkey, l_linenumber, o_orderstatus FROM (SELECT l_orderkey AS orderkey, l_linenumber FROM lineitem WHERE l_tax = 0.08) l
NATURAL JOIN (SELECT o_orderkey AS orderkey, o_orderstatus FROM orders) o""", cap=None)


@SQL.query("join_semi", """
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 5)""")
def join_semi(t):
    cheap = t.lineitem.where((F.col("l_discount") > 0.09) & (F.col("l_quantity") < 5)).select("l_partkey")
    return t.part.join(cheap, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@SQL.query("join_anti", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def join_anti(t):
    pending = t.orders.where(F.col("o_orderstatus") == "P").select("o_custkey")
    return t.customer.join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@SQL.query("join_range", """
SELECT p_partkey, COUNT(*) AS n_customers FROM part JOIN customer
ON c_acctbal BETWEEN p_retailprice AND p_retailprice + 0.35 GROUP BY p_partkey""")
def join_range(t):
    """Customers whose balance lies in the price band of a part."""
    balances = t.customer.groupBy("c_acctbal").agg(F.count(F.lit(1)).alias("n"))
    bands = t.part.select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 0.35).alias("hi"))
    return (
        range_join(balances, bands, "c_acctbal", "lo", "hi", width=0.5, levels=1)
        .groupBy("p_partkey").agg(F.sum("n").alias("n_customers"))
    )


@SQL.query("join_lateral", """
SELECT c_custkey, s.n, s.top_price FROM customer, LATERAL
(SELECT COUNT(*) AS n, MAX(o_totalprice) AS top_price FROM orders WHERE o_custkey = c_custkey) s""")
def join_lateral(t):
    return run_sql(t.register("customer", "orders"), """
SELECT c_custkey, s.n, s.top_price FROM customer, LATERAL
(SELECT COUNT(*) AS n, MAX(o_totalprice) AS top_price FROM orders WHERE o_custkey = c_custkey) s""", cap=None)


# --- aggregation ------------------------------------------------------------

@SQL.query("agg_basic", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total, MIN(l_shipdate) AS first_ship,
       MAX(l_shipdate) AS last_ship, CAST(SUM(l_quantity) AS BIGINT) AS quantity, SUM(l_quantity) / COUNT(*) AS avg_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_basic(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.sum("l_quantity").cast("long").alias("quantity"), F.avg("l_quantity").alias("avg_quantity"),
    )


@SQL.query("agg_round", """
SELECT l_suppkey, ROUND(SUM(l_extendedprice), 0) AS total, ROUND(AVG(l_quantity), 3) AS avg_quantity
FROM lineitem GROUP BY l_suppkey""")
def agg_round(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.sum("l_extendedprice"), 0).alias("total"), F.round(F.avg("l_quantity"), 3).alias("avg_quantity"))


@SQL.query("agg_case", """
SELECT o_custkey, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done,
       CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM orders GROUP BY o_custkey""")
def agg_case(t):
    def times(status):
        return F.sum(F.when(F.col("o_orderstatus") == status, 1).otherwise(0))

    return t.orders.groupBy("o_custkey").agg(times("F").alias("done"), times("O").alias("open"))


@SQL.query("agg_filter", """
SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS n_high, COUNT(*) AS n,
       ROUND(SUM(value) FILTER (WHERE user_id < 50), 2) AS early FROM events GROUP BY event_type""")
def agg_filter(t):
    return run_sql(t.register("events"), """
SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS n_high, COUNT(*) AS n,
       ROUND(SUM(value) FILTER (WHERE user_id < 50), 2) AS early FROM events GROUP BY event_type""", cap=None)


@SQL.query("agg_having", """
SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
HAVING COUNT(*) >= 12 AND SUM(o_totalprice) > 1000000""")
def agg_having(t):
    return (
        t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
        .where((F.col("n") >= 12) & (F.col("total") > 1000000)).withColumn("total", F.round("total", 2))
    )


@SQL.query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@SQL.query("count_distinct", """
SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""")
def count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@SQL.query("string_agg", """
SELECT o_custkey, STRING_AGG(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""")
def string_agg(t):
    """Distinct first: the list holds at most the five priorities there are."""
    return (
        t.orders.select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey")
        .agg(F.expr("listagg(o_orderpriority, '|') WITHIN GROUP (ORDER BY o_orderpriority)").alias("priorities"))
    )


@SQL.query("array_agg", """
SELECT user_id, array_to_string(list_sort(array_agg(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id""")
def array_agg(t):
    return t.events.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@SQL.query("stat_corr", """
SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag""")
def stat_corr(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@SQL.query("stat_regr", """
SELECT l_linenumber, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY l_linenumber""")
def stat_regr(t):
    return t.lineitem.groupBy("l_linenumber").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@SQL.query("pivot", """
SELECT l_suppkey, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS "A", COUNT(*) FILTER (WHERE l_returnflag = 'N') AS "N",
       COUNT(*) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY l_suppkey""")
def pivot(t):
    return t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)


@SQL.query("unpivot", """
UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME measure VALUE amount""")
def unpivot(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "measure", "amount")


@SQL.query("rollup", """
SELECT r_name, n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def rollup(t):
    """Counts per nation first; the rollup then expands 25 rows, not the table."""
    named = (
        t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return named.rollup("r_name", "n_name").agg(F.sum("n").alias("n"))


@SQL.query("cube", """
SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def cube(t):
    finest = t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return finest.cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("n").alias("n"))


# --- windows, on one row per customer and month ------------------------------

@SQL.query("win_rank", f"""
SELECT o_custkey, month, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY amount DESC, month) AS rn,
       RANK() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS dr
FROM {MONTHLY}""")
def win_rank(t):
    by_n = W.partitionBy("o_custkey").orderBy(F.desc("n"))
    return monthly(t).select(
        "o_custkey", "month",
        F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("amount"), "month")).alias("rn"),
        F.rank().over(by_n).alias("rk"), F.dense_rank().over(by_n).alias("dr"),
    ).withColumns({c: F.col(c).cast("long") for c in ("rn", "rk", "dr")})


@SQL.query("win_ntile", f"SELECT o_custkey, month, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY amount, month) AS quarter FROM {MONTHLY}")
def win_ntile(t):
    w = W.partitionBy("o_custkey").orderBy("amount", "month")
    return monthly(t).select("o_custkey", "month", F.ntile(4).over(w).cast("long").alias("quarter"))


@SQL.query("win_percent_rank", f"""
SELECT o_custkey, month, PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY n) AS pr,
       CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY n) AS cd FROM {MONTHLY}""")
def win_percent_rank(t):
    w = W.partitionBy("o_custkey").orderBy("n")
    return monthly(t).select("o_custkey", "month", F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))


@SQL.query("win_lag_lead", f"""
SELECT o_custkey, month, amount - LAG(amount) OVER (PARTITION BY o_custkey ORDER BY month) AS change,
       LEAD(month) OVER (PARTITION BY o_custkey ORDER BY month) AS next_month FROM {MONTHLY}""")
def win_lag_lead(t):
    w = W.partitionBy("o_custkey").orderBy("month")
    return monthly(t).select(
        "o_custkey", "month", (F.col("amount") - F.lag("amount").over(w)).alias("change"), F.lead("month").over(w).alias("next_month"))


@SQL.query("win_first_last", f"""
SELECT o_custkey, month, FIRST_VALUE(amount) OVER (PARTITION BY o_custkey ORDER BY month) AS first_amount,
       LAST_VALUE(amount) OVER (PARTITION BY o_custkey ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_amount
FROM {MONTHLY}""")
def win_first_last(t):
    w = W.partitionBy("o_custkey").orderBy("month")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return monthly(t).select(
        "o_custkey", "month", F.first("amount").over(w).alias("first_amount"), F.last("amount").over(whole).alias("last_amount"))


@SQL.query("win_nth", f"""
SELECT o_custkey, month, NTH_VALUE(amount, 2) OVER (PARTITION BY o_custkey ORDER BY month) AS second_amount FROM {MONTHLY}""")
def win_nth(t):
    w = W.partitionBy("o_custkey").orderBy("month")
    return monthly(t).select("o_custkey", "month", F.nth_value("amount", 2).over(w).alias("second_amount"))


@SQL.query("win_partition_count", f"SELECT o_custkey, month, COUNT(*) OVER (PARTITION BY o_custkey) AS months FROM {MONTHLY}")
def win_partition_count(t):
    return monthly(t).select("o_custkey", "month", F.count(F.lit(1)).over(W.partitionBy("o_custkey")).alias("months"))


@SQL.query("win_rows_frame", f"""
SELECT o_custkey, month, CAST(SUM(amount) OVER (PARTITION BY o_custkey ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3,
       CAST(SUM(amount) OVER (PARTITION BY o_custkey ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM {MONTHLY}""")
def win_rows_frame(t):
    w = W.partitionBy("o_custkey").orderBy("month")
    return monthly(t).select(
        "o_custkey", "month", F.sum("amount").over(w.rowsBetween(-2, 0)).alias("last3"),
        F.sum("amount").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("running"))


@SQL.query("win_range_frame", f"""
SELECT o_custkey, month, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY n RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS similar,
       CAST(SUM(amount) OVER (PARTITION BY o_custkey ORDER BY month RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last90
FROM {MONTHLY}""")
def win_range_frame(t):
    """Numeric range, and a 90-day range written on the day number."""
    by_n = W.partitionBy("o_custkey").orderBy("n").rangeBetween(-1, 1)
    by_day = W.partitionBy("o_custkey").orderBy(F.unix_date("month")).rangeBetween(-90, 0)
    return monthly(t).select(
        "o_custkey", "month", F.count(F.lit(1)).over(by_n).alias("similar"), F.sum("amount").over(by_day).alias("last90"))


# --- ordering, set operations, CTEs -------------------------------------------

@SQL.query("sort_expr", """
SELECT s_suppkey, s_acctbal FROM supplier ORDER BY ABS(s_acctbal - 5000) DESC NULLS LAST, s_suppkey""")
def sort_expr(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.abs(F.col("s_acctbal") - 5000).desc_nulls_last(), "s_suppkey")


@SQL.query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@SQL.query("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
def limit_offset(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.asc_nulls_last("c_acctbal"), "c_custkey").offset(40).limit(20)


@SQL.query("union_all", """
SELECT c_nationkey AS nationkey, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def union_all(t):
    buyers = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    sellers = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return buyers.union(sellers)


@SQL.query("union_distinct", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 1 UNION SELECT p_partkey FROM part WHERE p_size < 10")
def union_distinct(t):
    return (
        t.lineitem.where(F.col("l_quantity") == 1).select(F.col("l_partkey").alias("k"))
        .union(t.part.where(F.col("p_size") < 10).select("p_partkey")).distinct()
    )


@SQL.query("intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 1 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def intersect(t):
    return t.lineitem.where(F.col("l_quantity") == 1).select(F.col("l_partkey").alias("k")).intersect(
        t.part.where(F.col("p_size") < 10).select("p_partkey"))


@SQL.query("except", "SELECT p_partkey AS k FROM part WHERE p_size < 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def except_(t):
    return t.part.where(F.col("p_size") < 10).select(F.col("p_partkey").alias("k")).subtract(
        t.lineitem.where(F.col("l_quantity") == 1).select("l_partkey"))


CTE = """
WITH per_customer AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey),
     spread AS (SELECT n, COUNT(*) AS customers FROM per_customer GROUP BY n)
SELECT n, customers FROM spread WHERE customers > 1"""


@SQL.query("cte", CTE)
def cte(t):
    return run_sql(t.register("orders"), CTE, cap=None)


RECURSIVE = """
WITH RECURSIVE span AS (SELECT CAST(date_trunc('year', MIN(o_orderdate)) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders),
years(y, hi) AS (SELECT lo, hi FROM span UNION ALL SELECT CAST(y + INTERVAL '1' YEAR AS DATE), hi FROM years WHERE CAST(y + INTERVAL '1' YEAR AS DATE) <= hi),
counted AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS y, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT years.y AS first_day, COALESCE(n, 0) AS n FROM years LEFT JOIN counted ON years.y = counted.y"""


@SQL.query("cte_recursive", RECURSIVE)
def cte_recursive(t):
    """A calendar of years grown by recursion, filled from the orders."""
    return run_sql(t.register("orders"), RECURSIVE, cap=None)


# --- scalar functions -----------------------------------------------------------

@SQL.query("cond_exprs", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 10 THEN 'medium' ELSE 'small' END AS size_class,
       NULLIF(l_returnflag, 'N') AS returned, COALESCE(NULLIF(l_returnflag, 'N'), l_linestatus) AS flag FROM lineitem""")
def cond_exprs(t):
    returned = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_quantity") > 40, "large").when(F.col("l_quantity") > 10, "medium").otherwise("small").alias("size_class"),
        returned.alias("returned"), F.coalesce(returned, F.col("l_linestatus")).alias("flag"))


@SQL.query("casts", """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, CAST(FLOOR(o_totalprice) AS BIGINT) AS whole,
       TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS nothing,
       CAST(o_orderdate AS DATE) AS day FROM orders""")
def casts(t):
    return t.orders.select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("as_text"), F.floor("o_totalprice").cast("long").alias("whole"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("int").alias("level"),
        F.col("o_orderpriority").try_cast("double").alias("nothing"), F.col("o_orderdate").cast("date").alias("day"))


@SQL.query("string_fns", """
SELECT p_partkey, CAST(LENGTH(p_name) AS BIGINT) AS len, UPPER(p_name) AS up, LOWER(p_type) AS low, TRIM('  ' || p_brand || ' ') AS trimmed,
       CONCAT(p_brand, '/', p_type) AS joined, SUBSTR(p_name, 2, 3) AS mid, SUBSTRING(p_name, 1, 4) AS head,
       REPLACE(p_name, ' ', '_') AS replaced FROM part""")
def string_fns(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", F.length(name).cast("long").alias("len"), F.upper(name).alias("up"), F.lower("p_type").alias("low"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"), F.concat("p_brand", F.lit("/"), "p_type").alias("joined"),
        F.substr(name, F.lit(2), F.lit(3)).alias("mid"), F.substring(name, 1, 4).alias("head"),
        F.replace(name, F.lit(" "), F.lit("_")).alias("replaced"))


@SQL.query("math_fns", """
SELECT c_custkey, ABS(c_acctbal) AS abs_balance, CAST(FLOOR(c_acctbal) AS BIGINT) AS floor_balance, CAST(CEIL(c_acctbal) AS BIGINT) AS ceil_balance,
       ROUND(c_acctbal, 0) AS rounded, c_custkey / 7 AS seventh FROM customer""")
def math_fns(t):
    bal = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.abs(bal).alias("abs_balance"), F.floor(bal).alias("floor_balance"), F.ceil(bal).alias("ceil_balance"),
        F.round(bal, 0).alias("rounded"), (F.col("c_custkey") / 7).alias("seventh"))


@SQL.query("date_fns", """
SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(EXTRACT(month FROM ts) AS BIGINT) AS m, CAST(date_part('day', ts) AS BIGINT) AS d,
       CAST(date_part('hour', ts) AS BIGINT) AS h, CAST(date_part('dow', ts) AS BIGINT) AS dow, EPOCH(ts) AS epoch, ts < now() AS past FROM events""")
def date_fns(t):
    ts = F.col("ts")
    since = (ts - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)")
    parts = {"y": F.year(ts), "m": F.extract(F.lit("month"), ts), "d": F.date_part(F.lit("day"), ts), "h": F.hour(ts),
             "dow": F.dayofweek(ts) - 1}
    return t.events.select(
        "event_id", *[e.cast("long").alias(n) for n, e in parts.items()], since.cast("double").alias("epoch"),
        (ts < F.now()).alias("past"))


@SQL.query("date_trunc_series", """
SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2""")
def date_trunc_series(t):
    return t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@SQL.query("json_props", """
SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type""")
def json_props(t):
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


# --- functions and statements that only free SQL has -----------------------------------------

ZONES = """WITH zones AS (SELECT p_partkey AS id, p_partkey * 29 % 350 - 178 AS x0, p_partkey * 17 % 165 - 88 AS y0,
  p_partkey * 29 % 350 - 178 + p_partkey % 7 + 2 AS x1, p_partkey * 17 % 165 - 88 + p_partkey % 5 + 3 AS y1 FROM "part")"""
GAP = "sqrt(pow(greatest(x0 - 10, 10 - x1, 0), 2) + pow(greatest(y0 - 20, 20 - y1, 0), 2))"
LINE_GAP = "CASE WHEN y1 >= -10 AND y0 <= -10 AND x1 >= 0 AND x0 <= 40 THEN 0 ELSE sqrt(pow(greatest(x0 - 40, 0 - x1, 0), 2) + pow(greatest(y0 + 10, -10 - y1, 0), 2)) END"


@SQL.query("sql_spatial", f"""
{ZONES} SELECT id, ROUND({GAP}, 6) AS away, x0 < -156.5 AND x1 > -156.5 AND y0 < -79 AND y1 > -79 AS holds, ROUND({LINE_GAP}, 6) AS from_line
FROM zones WHERE {GAP} < 40 OR id % 3 = 0""")
def sql_spatial(t):
    """Rectangles as text, asked with spatial functions in a select list and in a condition."""
    shapes = """, shapes AS (SELECT id, concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') AS geometry_wkt FROM zones)"""
    return run_sql(t.register("part"), f"""{ZONES}{shapes}
SELECT id, ROUND(ST_Distance(ST_GeomFromText(geometry_wkt), ST_Point(10, 20)), 6) AS away,
  ST_Contains(ST_GeomFromText(geometry_wkt), ST_Point(-156.5, -79)) AS holds,
  ROUND(ST_Distance(ST_GeomFromText(geometry_wkt), 'LINESTRING (0 -10, 40 -10)'), 6) AS from_line
FROM shapes WHERE ST_DISTANCE(geometry_wkt, ST_POINT(10, 20)) < 40 OR id % 3 = 0""", cap=None)


EPOCHS = """SELECT event_type, COUNT(*) AS n, CAST(MIN(EPOCH(ts)) AS DOUBLE) AS first_second, CAST(floor(EPOCH(MAX(ts)) / 3600) AS BIGINT) AS last_hour,
  CAST(SUM(CAST(floor(EPOCH(ts) / 86400) AS BIGINT)) AS BIGINT) AS days FROM "events" WHERE EPOCH(ts) > 1704100000 GROUP BY event_type"""


@SQL.query("sql_epoch", EPOCHS)
def sql_epoch(t):
    return run_sql(t.register("events"), EPOCHS, cap=None)


JSON_PATHS = """SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
  COUNT(json_extract_string(props, '/k')) AS with_k, COUNT(json_extract_string(props, 'nothing')) AS with_nothing
FROM "events" WHERE json_extract_string(props, 'k') <> '7' GROUP BY event_type"""


@SQL.query("sql_json", JSON_PATHS)
def sql_json(t):
    return run_sql(t.register("events"), JSON_PATHS, cap=None)


@SQL.query("sql_summarize", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(MIN({c}) AS VARCHAR) AS "min", CAST(MAX({c}) AS VARCHAR) AS "max", COUNT(*) AS "count",
  ROUND(CAST(AVG({c}) AS DOUBLE), 6) AS avg, ROUND(CAST(STDDEV_SAMP({c}) AS DOUBLE), 6) AS std FROM orders WHERE o_orderstatus = 'F'""" for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def sql_summarize(t):
    """The profile of a query, asked for as a statement."""
    found = run_sql(t.register("orders"), "SUMMARIZE SELECT o_orderkey, o_custkey, o_totalprice FROM \"orders\" WHERE o_orderstatus = 'F'", cap=None)
    return found.select("column_name", "min", "max", "count", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"))


ORDERED_LIST = """SELECT c_nationkey, string_agg(upper(c_name), '; ' ORDER BY c_acctbal DESC, c_custkey) AS richest, COUNT(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM "customer") AS ranked
WHERE place <= 3 GROUP BY c_nationkey"""


@SQL.query("sql_string_agg", ORDERED_LIST)
def sql_string_agg(t):
    """The dialect's ordered list, of at most three names a group."""
    return run_sql(t.register("customer"), ORDERED_LIST, cap=None)


PIVOTED = """SELECT * FROM (SELECT l_suppkey, l_returnflag, l_quantity FROM "lineitem")
PIVOT (SUM(l_quantity) FOR l_returnflag IN ('A' AS flag_a, 'N' AS flag_n, 'R' AS flag_r))"""


@SQL.query("sql_pivot", PIVOTED)
def sql_pivot(t):
    return run_sql(t.register("lineitem"), PIVOTED, cap=None)


UNPIVOTED = """SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM "lineitem")
UNPIVOT (amount FOR measure IN (l_discount, l_tax)) WHERE amount > 0.05"""


@SQL.query("sql_unpivot", UNPIVOTED)
def sql_unpivot(t):
    return run_sql(t.register("lineitem"), UNPIVOTED, cap=None)
