"""Facts, matching and verdicts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from civiclake.operators import claims as c
from civiclake.operators import skew

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def facts_of(spark, text):
    df = spark.createDataFrame([("c", text)], "claim_id string, claim string")
    return [(r["kind"], r["num"] if r["kind"] != "string" else r["str"]) for r in c.extract_facts(df).orderBy("position").collect()]


@pytest.mark.parametrize("text,facts", [
    ("Usage increased by 45.2% last year.", [("percentage", 45.2)]),
    ("The city had 12,345 building permits.", [("integer", 12345.0)]),
    ("Average was 3.14 units.", [("float", 3.14)]),
    ("There were 42 incidents.", [("integer", 42.0)]),
    ('The top category was "residential".', [("string", "residential")]),
    ("Growth was 20%.", [("percentage", 20.0)]),
    ("Data looks good overall.", []),
    ("Up 1,234.5 % to 'a b' in Q3 of 2,024 and 1,23.", [
        ("percentage", 1234.5), ("integer", 2024.0), ("integer", 1.0), ("integer", 23.0), ("string", "a b")]),
    ("é5 x6 7e 8", [("integer", 8.0)]),
    ("12.5abc", [("integer", 12.0)]),
    ("45 % plus 3", [("percentage", 45.0), ("integer", 3.0)]),
])
def test_extract(spark, text, facts):
    assert facts_of(spark, text) == facts


def by_hand(text):
    """The three passes, one text at a time."""
    percent, quoted = re.compile(r"(\d[\d,]*\.?\d*)\s*%"), re.compile(r"""["']([^"']+)["']""")
    number = re.compile(r"(?<![%\w])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+)(?![%\w])")
    out = [("percentage", m.group(0)) for m in percent.finditer(text)]
    text = percent.sub("", text)
    out += [("float" if "." in m.group(1) else "integer", m.group(1)) for m in number.finditer(text)]
    text = number.sub("", text)
    return out + [("string", m.group(0)) for m in quoted.finditer(text)]


def test_whole_documents_match_python(spark):
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    got = {}
    for r in c.extract_facts(docs, "text").select("doc_id", "position", "kind", "raw").orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["raw"]))
    want = {r["doc_id"]: by_hand(r["text"]) for r in docs.collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert sum(map(len, got.values())) > 30


def test_tolerance_against_all_pairs(spark):
    rnd = random.Random(7)
    cells = [rnd.choice([1, -1]) * 10 ** rnd.uniform(-3, 9) for _ in range(300)] + [0.0, 99.5, 100.0, 100.5025, -0.4]
    probes = [v * k for v in cells for k in (0.9949, 0.99501, 1.0, 1.00499, 1.00503)] + [v + d for v in cells for d in (-0.501, -0.5, 0.5, 0.499)]
    index = spark.createDataFrame([("q", "col", v, str(v)) for v in cells], "result_id string, column string, num double, str string")
    asked = spark.createDataFrame([("q", v) for v in probes], "result_id string, num double")
    got = {r["num"] for r in c.match_tolerance(asked, index).collect()}
    want = {v for v in probes if any(math.isclose(v, d, rel_tol=0.005, abs_tol=0.5) for d in cells)}
    assert got == want
    facts = spark.createDataFrame([("q", i, "float", v, None) for i, v in enumerate(probes)], "result_id string, position int, kind string, num double, str string")
    assert {r["num"] for r in c.match_facts(facts, index).where("found_in is not null").collect()} == want


RESULTS = {
    "permits": [("city", "Springfield", None), ("permits", None, 12345.0)],
    "rate": [("category", "residential", None), ("rate", None, 0.452)],
    "pct": [("category", "A", None), ("pct", None, 45.2)],
    "growth": [("year", None, 2022.0), ("year", None, 2023.0), ("count", None, 100.0), ("count", None, 120.0)],
    "cities": [("city", "New   York", None), ("count", None, 500.0)],
    "cost": [("metric", "cost", None), ("value", None, 499.7)],
}
VERDICTS = [
    ("permits", "The city had 12,345 permits.", True),
    ("permits", "The city had 99,999 permits.", False),
    ("permits", "The city had many permits.", None),
    ("rate", 'The "residential" rate was 45.2%.', True),
    ("pct", "Category A had 45.2% share.", True),
    ("growth", "Count grew by 20% from 100 to 120.", None),
    ("growth", "Count grew from 100 to 'nowhere'.", False),
    ("empty", "The city had 100 permits.", None),
    ("cities", '"new york" had 500 incidents.', True),
    ("cost", "The cost was 500.", False),
    ("cost", "The cost was 499.9.", True),
    ("permits", "x" * 11_000, None),
]


def frames(spark, sql='SELECT * FROM "t"'):
    rows = [(k, col, text, num) for k, cells in RESULTS.items() for col, text, num in cells]
    raw = spark.createDataFrame(rows, "result_id string, column string, text string, num double")
    index = raw.select("result_id", "column", "num", c.normal_text(F.coalesce("text", F.col("num").cast("string"))).alias("str"))
    claims = spark.createDataFrame(
        [(str(i), r, text, sql) for i, (r, text, _) in enumerate(VERDICTS)], "claim_id string, result_id string, claim string, sql string")
    return index, claims.withColumn("started_at", F.lit("2024-01-02").cast("timestamp_ntz"))


def test_verdicts(spark):
    index, claims = frames(spark)
    got = {r["claim_id"]: r["claim_valid"] for r in c.claim_verdicts(claims, index, longest=10_000).collect()}
    assert [got[str(i)] for i in range(len(VERDICTS))] == [v for _, _, v in VERDICTS]


def test_rejected_statement_is_false(spark):
    index, claims = frames(spark, "DROP TABLE foo")
    got = {r["claim_valid"] for r in c.claim_verdicts(claims.where(F.length("claim") < 10000), index).collect()}
    assert got == {False}


def test_value_index_kinds(spark):
    df = spark.createDataFrame([("q", "  Two  Words ", " 12 ", True, 1.5e7, None)], "result_id string, a string, b string, f boolean, d double, n int")
    got = {(r["column"], r["num"], r["str"]) for r in c.value_index(df).collect()}
    assert got == {("a", None, "two words"), ("b", 12.0, "12"), ("f", 1.0, "true"), ("d", 1.5e7, "15000000.0")}


def test_stability_and_labels(spark):
    index, claims = frames(spark, 'SELECT * FROM "t_a" JOIN "t_b" ON 1 = 1')
    registry = spark.createDataFrame([("t_a", "2024-01-01"), ("t_b", "2024-01-01")], "table_name string, d string").selectExpr(
        "table_name", "cast(d as timestamp_ntz) downloaded_at")
    got = {r["claim_id"]: r for r in c.validate_claims(claims, index, registry, longest=10_000).collect()}
    assert got["0"]["label"] == "PASS" and got["1"]["label"] == "FAIL" and got["2"]["label"] == "UNVERIFIABLE"
    assert got["11"]["summary"].startswith("length: ")
    moved = c.validate_claims(claims, index, registry.withColumn("downloaded_at", F.lit("2024-01-03").cast("timestamp_ntz")))
    got = {r["claim_id"]: r["summary"] for r in moved.collect()}
    assert got["0"].startswith("tables: ") and got["1"].startswith("facts_and_tables: ")
    log = claims.withColumnRenamed("claim_id", "query_id")
    gone = c.data_stability(log, registry.where("table_name = 't_a'")).first()
    assert gone["stable"] is False and gone["unknown_tables"] == 1


def test_claims_of_any_length(spark):
    """A claim of 300,000 characters and 20,000 facts: all found but one."""
    index = spark.range(20_000).select(F.lit("q").alias("result_id"), F.lit("n").alias("column"), (F.col("id") * 3).cast("double").alias("num"), (F.col("id") * 3).cast("string").alias("str"))
    text = " and ".join(str(i * 3) for i in range(20_000))
    claims = spark.createDataFrame([("a", "q", text), ("b", "q", text + " and 'nothing'"), ("c", "q", text + " and 7")], "claim_id string, result_id string, claim string")
    got = {r["claim_id"]: (r["n_facts"], r["n_found"], r["claim_valid"]) for r in c.claim_verdicts(claims, index).collect()}
    assert got == {"a": (20_000, 20_000, True), "b": (20_001, 20_000, False), "c": (20_001, 20_000, None)}


def test_hot_result_is_dealt_over_tasks(spark):
    """Nine claims of ten are about one result, and all of them name one number."""
    index = spark.createDataFrame([("hot", "n", 5.0, "5"), ("q1", "n", 6.0, "6")], "result_id string, column string, num double, str string")
    claims = spark.range(4_000).select(
        F.col("id").cast("string").alias("claim_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("q"), F.col("id") % 3)).alias("result_id"), F.lit("It was 5.").alias("claim"))
    probes = c._probes(c.extract_facts(claims))
    met = c._look_up(probes, index, "result_id", claims)
    sizes = [r["count"] for r in skew.spread_join(claims, index, ["result_id"]).hint("rebalance").groupBy(F.spark_partition_id()).count().collect()]
    parts = skew.heavy_keys(claims, ["result_id"]).collect()
    assert sum(sizes) == 4_000 and [(r["result_id"], r["_parts"]) for r in parts if r["result_id"] == "hot"] == [("hot", 32)]
    assert met.where("result_id = 'hot' and column = 'n'").count() == 3_600 and met.where("result_id <> 'hot' and column is not null").count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.spread_join(claims, index, ["result_id"], "inner").withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in joined.groupBy("task").count().collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "hashpartitioning(result_id" in plan and "_part" in plan
    assert len(tasks) == 4 and max(tasks) < 0.6 * sum(tasks)  # four shuffle partitions; without the parts one would hold all 3,600


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, how):
    left = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 7).alias("k"), (F.col("id") % 5).alias("j"), "id")
    right = spark.createDataFrame([(k, j, k * 10 + j) for k in range(5) for j in range(4)], "k long, j long, v int")
    want = sorted(map(str, left.join(right, ["k", "j"], how).collect()))
    for heavy_on, share in ((None, 0.01), (["k"], 0.05), (["k"], 0.9)):
        assert sorted(map(str, skew.spread_join(left, right, ["k", "j"], how, heavy_on=heavy_on, share=share).collect())) == want
    with pytest.raises(ValueError):
        skew.spread_join(left, right, ["k"], "full")


def test_no_side_of_the_tolerance_join_is_broadcast(spark):
    from __spark_entry__ import queries
    plan = queries()["match_tolerance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("most", [2, 6, 250])
def test_verdicts_of_listed_and_large_results(spark, monkeypatch, most):
    """Results of more cells than a list may hold are looked up cell by cell: the same verdicts, for repeated claims as well."""
    monkeypatch.setattr(c, "MOST_LISTED", most)
    rnd = random.Random(5)
    cells = [(f"q{i % 6}", "col", v, str(v)) for i, v in enumerate(rnd.choice([1, -1]) * 10 ** rnd.uniform(-3, 6) for _ in range(60))]
    cells += [("q1", "name", None, "new york"), ("q7", "name", None, "oslo"), ("q7", "n", 7.0, "7"), ("q8", "n", 1e301, "huge"), ("q8", "m", float("nan"), "x"), ("q9", "e", None, "")]
    index = spark.createDataFrame(cells, "result_id string, column string, num double, str string").distinct()
    texts = {f"about {v * k:.4f} and 'New  York'" for _, _, v, _ in cells if v and abs(v) < 1e7 and v > 0 for k in (1, 1.004, 1.006)}
    texts |= {"7 of 'oslo'", "7 %", "700%", "nothing", "'oslo'", "8", "7 or 9"}
    claims = [(f"{r}-{i}", r, x) for i, x in enumerate(sorted(texts)) for r in ("q0", "q1", "q7", "q8", "q9", "none", None)] * 2
    claims += [("twice", "q7", "'oslo' 9"), ("twice", "q7", "'bergen' 7 8")]
    asked = spark.createDataFrame(claims, "claim_id string, result_id string, claim string")
    got = {tuple(x) for x in c.claim_verdicts(asked, index).collect()}
    monkeypatch.setattr(c, "MOST_LISTED", 0)
    want = {tuple(x) for x in c.claim_verdicts(asked, index).collect()}
    assert got == want and len(got) == len(set(claims)) - 1
    assert {x[-1] for x in got} == {True, False, None}
