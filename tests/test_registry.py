"""Names, staleness, the registry and the store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civiclake.functions import names
from civiclake.operators import registry as reg
from civiclake.operators.staleness import check_freshness, parse_moment, with_expiry, with_staleness
from civiclake.session import work_dir
from civiclake.sources.ingest import UnsupportedFormat, ingest, read_resource
from civiclake.sources.store import Store


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("title,resource,portal,geo,name", [
    ("My Dataset", "abcd1234-ef56", "province", False, "ds_province_my_dataset_abcd1234"),
    ("Health & Safety (2024)", "12345678-abcd", "province", False, "ds_province_health_safety_2024_12345678"),
    (None, "abcd1234", "province", False, "ds_province_unknown_abcd1234"),
    ("", "abcd1234", "city_a", True, "geo_city_a_geo_abcd1234"),
    ("a" * 100, "abcd1234", "city_a", False, "ds_city_a_" + "a" * 40 + "_abcd1234"),
    ("a" * 39 + " b", "x", "city_a", False, "ds_city_a_" + "a" * 39 + "__x"),
])
def test_table_name(spark, title, resource, portal, geo, name):
    assert one(spark, names.table_name(F.lit(title).cast("string"), F.lit(resource), F.lit(portal), geo)) == name


@pytest.mark.parametrize("table,portal", [
    ("ds_city_a_routes_abc12345", "city_a"), ("geo_city_b_zones_abc12345", "city_b"), ("ds_province_cases_abc12345", "province"),
    ("cases_abc12345", "province"), ("ds_bogus_something", "province"), ("ds_city_a", "province"),
])
def test_infer_portal(spark, table, portal):
    assert one(spark, names.infer_portal(F.lit(table))) == portal


@pytest.mark.parametrize("identifier,portal,bare", [
    ("city_a:abc123", "city_a", "abc123"), ("abc123", None, "abc123"), ("urn:uuid:abc", None, "urn:uuid:abc"),
    ("bogus:abc", None, "bogus:abc"), ("province:a:b", "province", "a:b"),
])
def test_prefixed_ids(spark, identifier, portal, bare):
    assert one(spark, names.id_portal(F.lit(identifier))) == portal
    assert one(spark, names.bare_id(F.lit(identifier))) == bare


def test_expiry_by_frequency(spark):
    days = {"daily": 2, "Weekly ": 10, "monthly": 45, "quarterly": 120, "biannually": 200, "yearly": 400,
            "as_required": 365, "on_demand": 365, "sometimes": 30, None: 30}
    df = spark.createDataFrame([(k,) for k in days], "update_frequency string").withColumn("downloaded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    base = dt.datetime(2024, 1, 1)
    assert {r["update_frequency"]: (r["expires_at"] - base).days for r in with_expiry(df).collect()} == days


def test_staleness(spark):
    df = spark.createDataFrame([
        ("old", "2024-01-01 00:00:00", None), ("edge", "2024-02-01 00:00:00", "2024-03-10 00:00:00"),
        ("fresh", "2024-03-09 12:00:00", None), ("none", None, None)], "resource_id string, d string, e string").selectExpr(
        "resource_id", "cast(d as timestamp_ntz) downloaded_at", "cast(e as timestamp_ntz) expires_at")
    got = {r["resource_id"]: (r["is_stale"], r["age_hours"]) for r in with_staleness(df, "2024-03-10 00:00:00").collect()}
    # Hours do not depend on the session's clock changes (10 March 2024 is one).
    assert got == {"old": (True, 1656.0), "edge": (False, 912.0), "fresh": (False, 12.0), "none": (None, None)}


def test_freshness(spark):
    rows = [("a", "daily", "2024-03-07T00:00:00"), ("b", "daily", "2024-03-08T12:00:00Z"), ("c", "Daily", "2024-01-01"),
            ("d", "yearly", "not a date"), ("e", "yearly", "2024-03-11T00:00:00+00:00"), ("f", "weekly", None)]
    df = spark.createDataFrame(rows, "id string, update_frequency string, metadata_modified string").selectExpr(
        "*", "'province' portal", "id title", "cast(null as string) current_as_of")
    got = {r["id"]: (r["days_since_update"], r["is_stale"]) for r in check_freshness(df, "2024-03-10 00:00:00").collect()}
    assert got == {"a": (3, True), "b": (1, False), "c": (69, None), "d": (None, None), "e": (-1, False), "f": (None, None)}


def test_moments_are_utc_whatever_the_zone(spark):
    assert one(spark, parse_moment(F.lit("1970-01-01T00:00:01"))) == 1_000_000
    assert one(spark, parse_moment(F.lit("1970-01-01T01:00:01+01:00"))) == 1_000_000


def test_empty_registry_totals(spark):
    empty = spark.createDataFrame([], reg.REGISTRY_SCHEMA)
    assert tuple(reg.registry_stats(empty).first()) == (0, 0, 0, 0.0)


@pytest.fixture(scope="module")
def store(spark):
    return Store(spark, work_dir(spark, "test-store"))


def test_store_lifecycle(spark, store):
    people = spark.createDataFrame([("Ann", "30"), ("Bob", "41"), ("Cy", "52")], "name string, age string")
    store.land(people, "r1", "d1", "ds_province_people_r1", "http://example.com/1", "daily", dt.datetime(2024, 1, 1))
    assert dict(store.table("r1").dtypes) == {"name": "string", "age": "double"}
    row = store.registry().first()
    assert (row["row_count"], row["expires_at"]) == (3, dt.datetime(2024, 1, 3)) and row["size_bytes"] > 0

    store.land(people.limit(1), "r1", "d1", "ds_province_people_r1", now=dt.datetime(2024, 1, 5))
    assert [(r["resource_id"], r["row_count"]) for r in store.registry().collect()] == [("r1", 1)]

    store.land(people, "r2", "d2", "geo_city_a_people_r2", now=dt.datetime(2024, 1, 1))
    assert sorted(store.register_views()) == ["ds_province_people_r1", "geo_city_a_people_r2"]
    assert spark.table("geo_city_a_people_r2").count() == 3

    def load(r):
        if r["portal"] == "city_a":
            raise RuntimeError("portal is down")
        return people

    report = {r["resource_id"]: r for r in store.refresh(load, now=dt.datetime(2024, 6, 1)).collect()}
    assert (report["r1"]["status"], report["r1"]["row_count"]) == ("refreshed", 3)
    assert (report["r2"]["status"], report["r2"]["error"]) == ("error", "portal is down")
    assert store.table("r2").count() == 3  # a failed refresh keeps the old table
    assert store.vacuum() == 2
    assert store.remove("r1") and not store.remove("r1")
    with pytest.raises(KeyError, match="r1"):
        store.table("r1")
    assert store.remove_all() == 1
    assert store.registry().count() == 0


def test_ingest_chooses_the_reader(spark, store):
    path = work_dir(spark, "ingest")
    spark.createDataFrame([("a;b", "1,000"), ("c", "2,500")], "`No of`  string, amount string").write.option("header", True).csv(path)
    first = ingest(store, path, "csv", "csv-1-xyz", "d", "Some Data!", "city_b", "monthly")
    assert first["status"] == "landed" and first["table_name"] == "ds_city_b_some_data_csv-1-xy"
    assert first["columns"] == [("No of", "string"), ("amount", "double")]
    assert ingest(store, path, "csv", "csv-1-xyz", "d", "Some Data!", "city_b")["status"] == "already_landed"
    with pytest.raises(UnsupportedFormat, match="XLSX"):
        read_resource(spark, path, "xlsx")
    with pytest.raises(ValueError, match="neither"):
        read_resource(spark, "", "csv")
