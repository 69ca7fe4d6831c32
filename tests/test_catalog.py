"""Catalogue operators on small hand-made catalogues."""

import itertools
import random

from pyspark.sql import functions as F

from civiclake.operators import catalog as cat
from civiclake.operators.query import describe_columns, drop_internal, preview, query_table

NULLS = ("metadata_created", "license_title", "geographic_coverage", "maintainer", "maintainer_en", "access_level", "current_as_of")


def datasets(spark, rows):
    df = spark.createDataFrame(rows, "portal string, id string, org_name string, tags array<string>, metadata_modified string")
    return df.selectExpr("*", "id name", "concat('title ', id) title", "concat('notes on ', id) notes", "upper(org_name) org_title",
                         "cast(null as string) update_frequency", *[f"cast(null as string) {c}" for c in NULLS])


def test_related_against_brute_force(spark):
    rnd = random.Random(11)
    tags = [f"t{i}" for i in range(12)] + ["hot"] * 6
    rows = []
    for i in range(160):
        own = list(dict.fromkeys(rnd.choices(tags, k=rnd.randint(0, 8))))
        rows.append((rnd.choice(["province", "city_a"]), f"d{i}", rnd.choice(["o1", "o2", "o3", "", None]), own, rnd.choice(["2024-01-01", "2024-02-02", None, f"2023-01-{i % 28 + 1:02d}"])))
    by_age = sorted(rows, key=lambda r: r[1])
    by_age.sort(key=lambda r: r[4] or "", reverse=True)
    want = {}
    for portal, ident, org, own, _ in rows:
        peers = [r for r in by_age if r[0] == portal and r[1] != ident]
        tagged = [r for r in peers if set(r[3]) & set(own)]
        found = [(r[1], "tags", [t for t in r[3] if t in own]) for r in tagged]
        found += [(r[1], "same_organization", []) for r in peers if org and r[2] == org and r not in tagged]
        want[f"{portal}:{ident}"] = [(f"{portal}:{i}", w, sorted(s)) for i, w, s in found[:4]]
    got = {}
    for r in cat.related_datasets(datasets(spark, rows), limit=4).orderBy("source_id", "place").collect():
        got.setdefault(r["source_id"], []).append((r["id"], r["relevance"], sorted(r["shared_tags"])))
    assert got == {k: v for k, v in want.items() if v}


def test_resolution_order(spark):
    known = datasets(spark, [("city_a", "x", "o", [], None), ("province", "x", "o", [], None), ("city_b", "y", "o", [], None)])
    asked = spark.createDataFrame([(i,) for i in ("x", "city_a:x", "city_b:x", "y", "urn:z", "province:y")], "request string")
    got = {r["request"]: (r["portal"], r["tried"]) for r in cat.resolve_ids(asked, known).collect()}
    everywhere = "province, city_a, city_b"
    assert got == {"x": ("province", None), "city_a:x": ("city_a", None), "city_b:x": (None, "city_b"), "y": ("city_b", None),
                   "urn:z": (None, everywhere), "province:y": (None, "province")}


def test_split_catalog_with_missing_fields(spark):
    records = spark.read.json(spark.sparkContext.parallelize([
        '{"id": "a", "title": "A", "organization": {"title": "Org"}, "tags": [{"name": "x"}], "resources": [{"id": "r", "format": "csv", "data_last_updated": "2024"}]}',
        '{"id": "b", "title": "B", "resources": []}']))
    d, r = cat.split_catalog(records, "city_a")
    assert tuple(d.columns) == cat.DATASET_COLUMNS and tuple(r.columns) == cat.RESOURCE_COLUMNS
    rows = {x["id"]: x for x in d.collect()}
    assert rows["a"]["org_title"] == "Org" and rows["a"]["tags"] == ["x"] and rows["b"]["tags"] == []
    assert [(x["package_id"], x["id"], x["last_modified"]) for x in r.collect()] == [("a", "r", "2024")]
    summary = {x["id"]: x for x in cat.summary_columns(d, r).collect()}
    assert summary["city_a:a"]["formats"] == ["CSV"] and summary["city_a:b"]["num_resources"] == 0
    assert summary["city_a:b"]["organization"] == "Unknown" and summary["city_a:b"]["update_frequency"] == "unknown"


def test_organizations_without_datasets(spark):
    d = datasets(spark, [("province", "a", "o1", [], None), ("province", "b", "o1", [], None), ("city_a", "c", "o2", [], None)])
    orgs = spark.createDataFrame([("province", "o1", "One", "x" * 200), ("province", "o0", "Zero", None)], "portal string, name string, title string, description string")
    got = [(r["portal"], r["name"], r["title"], r["dataset_count"], len(r["description"])) for r in cat.list_organizations(d, orgs).collect()]
    assert got == [("province", "o1", "One", 2, 150), ("province", "o0", "Zero", 0, 0), ("city_a", "o2", "O2", 1, 0)]


def test_shared_tags_of_chosen(spark):
    d = datasets(spark, [("province", "a", "o", ["x", "y", "z"], None), ("city_a", "b", "o", ["y", "x"], None), ("city_b", "c", "o", ["x"], None)])
    r = spark.createDataFrame([("province", "a", "r1", "csv")], "portal string, package_id string, id string, format string")
    for ids in itertools.permutations(["a", "city_a:b"]):
        got = {x["id"]: x["shared_tags"] for x in cat.compare_datasets(d, r, ids).collect()}
        assert got == {"province:a": ["x", "y"], "city_a:b": ["x", "y"]}


def test_structured_query(spark):
    df = spark.range(3000).select(F.col("id").alias("row id"), (F.col("id") % 3).alias("g"), F.lit(1).alias("_id"))
    page = query_table(df, {"g": 1}, ["row id"], 'g asc, "row id" desc', limit=5000)
    assert page.columns == ["row id"] and page.count() == 1000 and query_table(df, limit=None).count() == 3000 and query_table(df, limit=2500).count() == 2500 and page.first()[0] == 2998
    assert query_table(df, {"g": [0, 2]}, sort="row id", limit=2, offset=1).collect()[0]["row id"] == 2
    assert drop_internal(df).columns == ["row id", "g"] and preview(df, 500).count() == 500
    described = {r["name"]: (r["type"], r["sample_values"]) for r in describe_columns(df, 3, "row id").collect()}
    assert described == {"row id": ("bigint", ["0", "1", "2"]), "g": ("bigint", ["0", "1", "2"])}


def test_related_without_broadcast_or_rows_per_candidate(spark):
    """A source that is there twice, a null id and null dates; only small tables of heavy keys are broadcast, and no candidate is grouped by itself."""
    rows = [("province", "a", "o1", ["x", "y"], "2024-01-01"), ("province", "a", "o1", ["x", "y"], "2024-01-01"), ("province", "b", "o1", ["x"], None),
            ("province", "c", "o1", [], "2024-03-03"), ("province", None, "o1", ["x"], "2025-01-01"), ("city_a", "d", "o1", ["x"], "2024-01-01")]
    found = cat.related_datasets(datasets(spark, rows), limit=3)
    got = sorted((r["source_id"], r["place"], r["id"], r["relevance"]) for r in found.collect())
    a = [("province:a", 1, "province:b", "tags"), ("province:a", 2, "province:c", "same_organization")]
    b = [("province:b", 1, "province:a", "tags"), ("province:b", 2, "province:c", "same_organization")]
    c = [("province:c", 1, "province:a", "same_organization"), ("province:c", 2, "province:b", "same_organization")]
    assert got == sorted([*a * 2, b[0], b[0], b[1], c[0], c[0], c[1]])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(step" not in plan and plan.count("strategy=merge") >= 2
