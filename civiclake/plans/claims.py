"""Claim checking."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.operators import claims as c
from civiclake.plans import fixtures as fx
from civiclake.plans.suite import Suite

CHECKS = Suite()

FACTS = f"""(SELECT claim_id, result_id, v, kind, num, str FROM (
 SELECT *, 'integer' AS kind, CAST(CASE v WHEN 1 THEN n + 900000 ELSE n END AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str FROM {fx.CLAIMS} WHERE v IN (0, 1, 3, 7)
 UNION ALL SELECT *, 'string', NULL, CASE v WHEN 0 THEN lower(o_orderstatus) ELSE 'nope' END FROM {fx.CLAIMS} WHERE v IN (0, 5)
 UNION ALL SELECT *, 'percentage', CASE v WHEN 3 THEN 98765432109.5::DOUBLE ELSE n * 1.5625::DOUBLE END, NULL FROM {fx.CLAIMS} WHERE v IN (3, 6)
 UNION ALL SELECT *, 'float', CAST(CAST(amount AS DECIMAL(18, 2)) + 0.25 AS DOUBLE), NULL FROM {fx.CLAIMS} WHERE v = 4))"""

CELLS = f"""(SELECT result_id, 'o_custkey' AS "column", CAST(o_custkey AS DOUBLE) AS num, CAST(o_custkey AS VARCHAR) AS str FROM {fx.CLAIM_RESULTS}
 UNION SELECT result_id, 'o_orderstatus', NULL, lower(o_orderstatus) FROM {fx.CLAIM_RESULTS}
 UNION SELECT result_id, 'n', CAST(n AS DOUBLE), CAST(n AS VARCHAR) FROM {fx.CLAIM_RESULTS}
 UNION SELECT result_id, 'amount', amount, CAST(amount AS VARCHAR) FROM {fx.CLAIM_RESULTS}
 UNION SELECT result_id, 'rate', rate, CAST(rate AS VARCHAR) FROM {fx.CLAIM_RESULTS})"""


def near(value: str) -> str:
    return f"abs(c.num - {value}) <= greatest(0.005 * greatest(abs(c.num), abs({value})), 0.5)"


def facts(t):
    return c.extract_facts(fx.claims(t).select("claim_id", "result_id", "claim"))


def index(t):
    return c.value_index(fx.claim_results(t))


@CHECKS.query("extract_facts", f"SELECT claim_id, kind, num, str FROM {FACTS}")
def extract(t):
    return facts(t).select("claim_id", "kind", "num", "str")


# SQL without look-around: a run of letters and digits that is no number becomes one letter, and each run of digits gets a mark at its end.
DIGIT, MARK = "\\p{Nd}", "\x01"
IN_WORD = "\\p{L}\\p{M}\\p{Nl}\\p{Pc}%"
PERCENT_SQL = f"({DIGIT}[{DIGIT},]*\\.?{DIGIT}*)[\\s\x0b\x85\xa0\u2028\u2029]*%"
NUMBER_SQL = f"{DIGIT}{{1,3}}{MARK}(?:,{DIGIT}{{3}}{MARK})+(?:\\.{DIGIT}+{MARK})?|{DIGIT}+{MARK}\\.{DIGIT}+{MARK}|{DIGIT}+{MARK}"
FACT_COUNTS = f"""
WITH p AS (SELECT doc_id, lang, len(regexp_extract_all(text, '{PERCENT_SQL}')) AS percentage, replace(regexp_replace(text, '{PERCENT_SQL}', '', 'g'), '{MARK}', ' ') AS t FROM documents),
m AS (SELECT doc_id, lang, percentage, regexp_replace(regexp_replace(t, '{DIGIT}*[{IN_WORD}][{DIGIT}{IN_WORD}]*', 'x', 'g'), '({DIGIT}+)', '\\1{MARK}', 'g') AS t FROM p),
n AS (SELECT doc_id, lang, percentage, regexp_extract_all(t, '{NUMBER_SQL}') AS numbers, len(regexp_extract_all(regexp_replace(t, '{NUMBER_SQL}', '', 'g'), '["''][^"'']+["'']')) AS string FROM m),
k AS (SELECT doc_id, lang, percentage, len(list_filter(numbers, lambda x: contains(x, '.'))) AS float, len(list_filter(numbers, lambda x: NOT contains(x, '.'))) AS integer, string FROM n),
u AS (UNPIVOT k ON percentage, float, integer, string INTO NAME kind VALUE n)
SELECT lang, kind, CAST(SUM(n) AS BIGINT) AS n_facts, COUNT(DISTINCT doc_id) AS n_documents FROM u WHERE n > 0 GROUP BY lang, kind"""


@CHECKS.query("fact_counts", FACT_COUNTS)
def fact_counts(t):
    """Facts of each kind in the whole texts of all documents."""
    return c.extract_facts(t.documents.select("doc_id", "lang", "text"), "text").groupBy("lang", "kind").agg(
        F.count(F.lit(1)).alias("n_facts"), F.countDistinct("doc_id").alias("n_documents"))


@CHECKS.query("value_index", f"SELECT * FROM {CELLS}")
def value_index(t):
    return index(t)


@CHECKS.query("match_integer", f"""
SELECT claim_id, num, EXISTS (SELECT 1 FROM {CELLS} c WHERE c.result_id = f.result_id AND c.num = f.num) AS found FROM {FACTS} f WHERE kind = 'integer'""")
def match_integer(t):
    return c.match_facts(facts(t).where(F.col("kind") == "integer"), index(t)).select(
        "claim_id", "num", F.col("found_in").isNotNull().alias("found"))


@CHECKS.query("match_tolerance", f"""
WITH p AS (SELECT result_id, num * k AS num FROM {CELLS} CROSS JOIN (SELECT unnest([0.99::DOUBLE, 0.9951, 1.004, 1.0049, 1.0051, 1.02]) AS k) WHERE num IS NOT NULL),
d AS (SELECT DISTINCT result_id, num FROM p)
SELECT result_id, num, EXISTS (SELECT 1 FROM {CELLS} c WHERE c.result_id = d.result_id AND {near('d.num')}) AS found FROM d""")
def match_tolerance(t):
    """Every number of every result, scaled to both sides of the tolerance."""
    cells = index(t)
    scales = F.explode(F.array(*[F.lit(k) for k in (0.99, 0.9951, 1.004, 1.0049, 1.0051, 1.02)]))
    probes = cells.where(F.col("num").isNotNull()).select("result_id", "num", scales.alias("k")).select(
        "result_id", (F.col("num") * F.col("k")).alias("num")).distinct()
    found = c.match_tolerance(probes, cells)
    # About as many rows as there are probes: too many for a broadcast, whatever the estimate says.
    return probes.join(found.hint("merge"), ["result_id", "num"], "left").select("result_id", "num", F.col("column").isNotNull().alias("found"))


@CHECKS.query("match_percentage", f"""
SELECT claim_id, num, EXISTS (SELECT 1 FROM {CELLS} c WHERE c.result_id = f.result_id AND ({near('f.num')} OR {near('(f.num / 100)')})) AS found
FROM {FACTS} f WHERE kind = 'percentage'""")
def match_percentage(t):
    return c.match_facts(facts(t).where(F.col("kind") == "percentage"), index(t)).select(
        "claim_id", "num", F.col("found_in").isNotNull().alias("found"))


@CHECKS.query("match_string", f"""
SELECT claim_id, str, EXISTS (SELECT 1 FROM {CELLS} c WHERE c.result_id = f.result_id AND c.str = lower(f.str)) AS found FROM {FACTS} f WHERE kind = 'string'""")
def match_string(t):
    return c.match_facts(facts(t).where(F.col("kind") == "string"), index(t)).select(
        "claim_id", "str", F.col("found_in").isNotNull().alias("found"))


VERDICT = "CASE WHEN v IN (0, 4, 6) THEN true WHEN v IN (1, 5, 7) THEN false END"


@CHECKS.query("claim_verdicts", f"SELECT claim_id, {VERDICT} AS claim_valid FROM {fx.CLAIMS}")
def claim_verdicts(t):
    return c.claim_verdicts(fx.claims(t), index(t)).select("claim_id", "claim_valid")


@CHECKS.query("data_stability", f"""
WITH l AS (SELECT o_orderkey AS query_id, {fx.LOG_KIND} AS kind, o_orderdate + INTERVAL 10 DAY AS started_at FROM orders),
n AS (SELECT query_id, started_at, concat('ds_province_t_', query_id) AS table_name FROM l WHERE kind IN (0, 2, 4, 5, 7, 8)
 UNION ALL SELECT query_id, started_at, concat('ds_province_t_', query_id + 3) FROM l WHERE kind = 7),
s AS (SELECT query_id, bool_and(downloaded_at IS NOT NULL AND downloaded_at <= started_at) AS stable,
 COUNT(*) FILTER (WHERE downloaded_at IS NULL) AS unknown_tables, COUNT(*) FILTER (WHERE downloaded_at > started_at) AS refreshed_tables
 FROM n LEFT JOIN {fx.REGISTRY} g USING (table_name) GROUP BY query_id)
SELECT query_id, stable, unknown_tables, refreshed_tables FROM l LEFT JOIN s USING (query_id)""")
def stability(t):
    return c.data_stability(fx.query_log(t), fx.registry(t))


@CHECKS.query("validate_claims", f"""
WITH k AS (SELECT claim_id, {VERDICT} AS claim_valid, CASE WHEN v != 7 THEN COALESCE(o_orderdate <= TIMESTAMP '1998-06-01', false) END AS stable
 FROM {fx.CLAIMS} c LEFT JOIN orders ON o_orderkey = c.o_custkey),
w AS (SELECT *, CASE WHEN claim_valid = false OR stable = false THEN false WHEN claim_valid THEN true END AS valid FROM k)
SELECT claim_id, claim_valid, stable, valid, CASE WHEN valid IS NULL THEN 'UNVERIFIABLE' WHEN valid THEN 'PASS' ELSE 'FAIL' END AS label FROM w""")
def validate(t):
    return c.validate_claims(fx.claims(t), index(t), fx.registry(t)).select("claim_id", "claim_valid", "stable", "valid", "label")
