"""Numeric repair, column profiles and duplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.operators.profile import duplicate_rows, profile, quality_report, repeated_rows
from civiclake.operators.quantiles import exact_quantiles
from civiclake.operators.statistics import profile_merged, update_statistics
from civiclake.operators.typing_repair import detect_numeric_strings, infer_types, repair_numeric
from civiclake.plans.fixtures import DUP_ROWS, MESSY, dup_rows, messy
from civiclake.plans.suite import Suite
from civiclake.session import work_dir

PROFILING = Suite()

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in names)


PLAIN = r"'^-?\d+\.?\d*$'"
COMMA = r"'^-?\d{1,3}(,\d{3})+(\.\d+)?$'"

DETECT = "WITH m AS " + MESSY + ", v AS (" + union(
    "SELECT DISTINCT '{c}' AS \"column\", trim({c}) AS value FROM m WHERE {c} IS NOT NULL",
    ["plain_text", "comma_text", "edge_text", "padded_text", "label"]) + f""")
SELECT "column", COUNT(*) AS n_values, COUNT(*) FILTER (WHERE regexp_matches(value, {PLAIN})) AS n_plain,
 COUNT(*) FILTER (WHERE regexp_matches(value, {COMMA})) AS n_comma,
 COUNT(*) FILTER (WHERE regexp_matches(value, {PLAIN}) OR regexp_matches(value, {COMMA})) / COUNT(*) > 0.8 AS is_numeric,
 COUNT(*) FILTER (WHERE regexp_matches(value, {COMMA})) > 0 AS has_commas
FROM v WHERE value != '' GROUP BY "column\""""


@PROFILING.query("detect_numeric_strings", DETECT)
def detect(t):
    return detect_numeric_strings(messy(t))


@PROFILING.query("repair_numeric", f"""
SELECT id, TRY_CAST(plain_text AS DOUBLE) AS plain_text, TRY_CAST(trim(padded_text) AS DOUBLE) AS padded_text, edge_text, label FROM {MESSY}""")
def repair(t):
    return repair_numeric(messy(t).drop("comma_text"))


@PROFILING.query("repair_numeric_commas", f"SELECT id, TRY_CAST(REPLACE(comma_text, ',', '') AS DOUBLE) AS comma_text FROM {MESSY}")
def repair_commas(t):
    return repair_numeric(messy(t).select("id", "comma_text"))


@PROFILING.query("infer_types", f"""
SELECT id, TRY_CAST(plain_text AS DOUBLE) AS plain_text, comma_text, edge_text, TRY_CAST(trim(padded_text) AS DOUBLE) AS padded_text, label FROM {MESSY}""")
def inferred(t):
    """All columns handed over as text, as a CSV file would; types come back."""
    texts = messy(t)
    return infer_types(texts.select(*[F.col(c).cast("string").alias(c) for c in texts.columns]))


@PROFILING.query("profile_numeric", union("""
SELECT '{c}' AS column_name, 'double' AS column_type, COUNT(*) AS "count", ROUND(AVG({c}), 6) AS avg, ROUND(STDDEV_SAMP({c}), 6) AS std FROM lineitem""", NUMERIC))
def profile_numeric(t):
    return profile(t.lineitem.select(*NUMERIC)).select(
        "column_name", "column_type", "count", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"))


@PROFILING.query("profile_nulls", "WITH d AS " + DUP_ROWS + union("""
SELECT '{c}' AS column_name, COUNT(*) AS "count", ROUND((COUNT(*) - COUNT({c})) * 100 / COUNT(*), 2) AS null_percentage FROM d""",
    ["l_partkey", "l_linenumber", "l_returnflag", "q"]))
def profile_nulls(t):
    return profile(dup_rows(t)).select("column_name", "count", "null_percentage")


@PROFILING.query("profile_minmax", union("""
SELECT '{c}' AS column_name, CAST(MIN({c}) AS VARCHAR) AS "min", CAST(MAX({c}) AS VARCHAR) AS "max" FROM orders""",
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def profile_minmax(t):
    return profile(t.orders).select("column_name", "min", "max")


@PROFILING.query("profile_quantiles", union("""
SELECT '{c}' AS "column", u.p AS prob, ROUND(u.v, 6) AS quantile FROM (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS p,
 unnest(quantile_cont({c}, [0.25, 0.5, 0.75])) AS v FROM lineitem) u""", NUMERIC))
def profile_quantiles(t):
    return exact_quantiles(t.lineitem.select(*NUMERIC), NUMERIC, [0.25, 0.5, 0.75]).withColumn("quantile", F.round("quantile", 6))


@PROFILING.query("profile_events", union("""
SELECT '{c}' AS column_name, CAST(MIN({c}) AS VARCHAR) AS "min", CAST(MAX({c}) AS VARCHAR) AS "max", COUNT(*) AS "count",
 ROUND((COUNT(*) - COUNT({c})) * 100 / COUNT(*), 2) AS null_percentage, true AS unique_close, true AS quartiles_close FROM events""", EVENT_COLUMNS))
def profile_events(t):
    """The whole profile row of each column; estimates are compared with exact values."""
    found = profile(t.events.select(*EVENT_COLUMNS))
    exact = t.events.agg(*[F.countDistinct(c).alias(c) for c in EVENT_COLUMNS]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in EVENT_COLUMNS])))
    numbers = ["event_id", "user_id", "value"]
    ends = exact_quantiles(t.events, numbers, [0.2, 0.3, 0.45, 0.55, 0.7, 0.8]).groupBy(F.col("column").alias("column_name")).agg(
        F.map_from_entries(F.collect_list(F.struct("prob", "quantile"))).alias("q"))
    inside = F.lit(True)
    for name, low, high in (("q25", 0.2, 0.3), ("q50", 0.45, 0.55), ("q75", 0.7, 0.8)):
        inside &= F.col(name).try_cast("double").between(F.col("q")[F.lit(low)], F.col("q")[F.lit(high)])
    return found.join(exact, "column_name").join(ends, "column_name", "left").select(
        "column_name", "min", "max", "count", "null_percentage", (F.abs(F.col("approx_unique") - F.col("n")) <= 0.15 * F.col("n")).alias("unique_close"),
        F.when(F.col("q").isNull(), True).otherwise(inside).alias("quartiles_close"))


@PROFILING.query("profile_repaired", f"""
SELECT 'plain_text' AS column_name, 'double' AS column_type, ROUND(AVG(TRY_CAST(plain_text AS DOUBLE)), 6) AS avg, COUNT(*) AS "count" FROM {MESSY}
UNION ALL SELECT 'comma_text', 'double', ROUND(AVG(TRY_CAST(REPLACE(comma_text, ',', '') AS DOUBLE)), 6), COUNT(*) FROM {MESSY}""")
def profile_repaired(t):
    return profile(repair_numeric(messy(t).select("plain_text", "comma_text"))).select(
        "column_name", "column_type", F.round("avg", 6).alias("avg"), "count")


@PROFILING.query("duplicate_rows", f"""
SELECT COUNT(*) AS duplicate_rows FROM (SELECT COUNT(*) OVER (PARTITION BY l_partkey, l_linenumber, l_returnflag, q) AS c FROM {DUP_ROWS}) WHERE c > 1""")
def duplicates(t):
    return duplicate_rows(dup_rows(t))


@PROFILING.query("duplicate_rows_window", f"""
SELECT DISTINCT l_partkey, l_linenumber, l_returnflag, q, c AS copies FROM
(SELECT *, COUNT(*) OVER (PARTITION BY l_partkey, l_linenumber, l_returnflag, q) AS c FROM {DUP_ROWS}) WHERE c > 1""")
def duplicates_listed(t):
    """The tuples that a full-row window would flag; grouping finds them without sorting rows."""
    return repeated_rows(dup_rows(t))


@PROFILING.query("quality_report", f"""
SELECT COUNT(*) AS row_count, COUNT(*) FILTER (WHERE c > 1) AS duplicate_rows FROM
(SELECT COUNT(*) OVER (PARTITION BY l_partkey, l_linenumber, l_returnflag, q) AS c FROM {DUP_ROWS})""")
def quality(t):
    return quality_report(dup_rows(t))


@PROFILING.query("profile_merged", union("""
SELECT '{c}' AS column_name, 'double' AS column_type, CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high, COUNT(*) AS "count",
 true AS mean_close, true AS spread_close, true AS unique_close, true AS middle_close FROM lineitem""", NUMERIC))
def merged(t):
    """lineitem landed in three steps; each step reads only its new files, and the profile only the statistics."""
    folder = work_dir(t.spark, "statistics")
    rows = t.lineitem.select("l_orderkey", *NUMERIC)
    for step in range(3):
        rows.where(F.col("l_orderkey") % 3 == step).drop("l_orderkey").write.mode("append").parquet(f"{folder}/table")
        update_statistics(t.spark, f"{folder}/table", f"{folder}/statistics")
    found = profile_merged(t.spark, f"{folder}/table", f"{folder}/statistics")
    # Against exact values: means and deviations but for rounding, distinct counts within 5 %, the middle between the exact 45 % and 55 % quantiles.
    exact = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in NUMERIC])))
    distinct = exact.groupBy("column_name").agg(F.countDistinct("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("spread"))
    ends = exact_quantiles(rows, NUMERIC, [0.45, 0.55]).groupBy(F.col("column").alias("column_name")).agg(F.min("quantile").alias("a"), F.max("quantile").alias("b"))
    return found.join(distinct, "column_name").join(ends, "column_name").select(
        "column_name", "column_type", F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high"), "count",
        (F.abs(F.col("avg") - F.col("mean")) <= 1e-9 * F.col("mean")).alias("mean_close"),
        (F.abs(F.col("std") - F.col("spread")) <= 1e-9 * F.col("spread")).alias("spread_close"),
        (F.abs(F.col("approx_unique") - F.col("n")) <= 0.05 * F.col("n")).alias("unique_close"), F.col("q50").between(F.col("a"), F.col("b")).alias("middle_close"))
