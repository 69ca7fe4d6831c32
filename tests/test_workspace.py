"""From a landed file to a checked claim."""

import json

import pytest

from civiclake.operators.freesql import InvalidQuery
from civiclake.sources.store import Store
from civiclake.session import work_dir
from civiclake.sources.pages import read_catalog_pages
from civiclake.workspace import Workspace


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ws")
    csv = folder / "permits.csv"
    csv.write_text("city,permits,rate\n" + "".join(f"c{i},\"{i},{i:03d}\",0.{i % 10}\n" for i in range(1, 60)))
    geo = folder / "zones.json"
    geo.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"zone": z}, "geometry": {"type": "Polygon", "coordinates": [[[z, 0], [z + 2, 0], [z + 2, 2], [z, 2], [z, 0]]]}}
        for z in range(0, 40, 2)]}))
    catalog = folder / "catalog.json"
    catalog.write_text(json.dumps({"success": True, "result": {"count": 2, "results": [
        {"id": "d1", "name": "permits", "title": "Building permits", "notes": "n", "organization": {"name": "o", "title": "Org"}, "tags": [{"name": "city"}],
         "metadata_modified": "2024-05-01T00:00:00", "update_frequency": "daily", "resources": [{"id": "p-1", "format": "CSV", "size": 5}]},
        {"id": "d2", "name": "zones", "title": "Zones", "notes": "z", "organization": {"name": "o", "title": "Org"}, "tags": [{"name": "city"}, {"name": "map"}],
         "metadata_modified": "2024-05-02T00:00:00", "update_frequency": "odd", "resources": [{"id": "z-1", "format": "GeoJSON", "size": 9}]}]}}))
    work = Workspace(spark, work_dir(spark, "workspace"))
    work.add_catalog("city_a", read_catalog_pages(spark, str(catalog)))
    assert work.land(str(csv), "CSV", "city_a:p-1", "d1", "permits", "city_a", update_frequency="daily")["table_name"] == "ds_city_a_permits_p-1"
    report = work.land(str(geo), "GEOJSON", "z-1", "d2", "zones", "city_a", geo=True)
    assert (report["row_count"], report["maxx"], report["geometry_types"]) == (20, 40.0, ["Polygon"])
    return work


def test_catalogue(ws):
    assert [r["id"] for r in ws.search("permits").collect()] == ["city_a:d1"]
    assert ws.files("d2").first()["format"] == "GeoJSON"
    assert [(r["id"], r["relevance"]) for r in ws.related("d1").collect()] == [("city_a:d2", "tags")]
    assert ws.geo_datasets().first()["resource_id"] == "z-1"
    assert ws.compare(["d1", "city_a:d2"]).first()["shared_tags"] == ["city"]
    assert ws.topics().first()["name"] == "city" and ws.organizations().first()["dataset_count"] == 2
    assert ws.portal_stats().where("portal = 'city_a'").first()["total_datasets"] == 2
    fresh = {r["id"]: r["is_stale"] for r in ws.freshness(now="2024-05-04 12:00:00").collect()}
    assert fresh == {"d1": True, "d2": None}
    assert ws.dataset("d1").first()["organization"] == "Org"


def test_tables_and_sql(ws):
    assert dict(ws.table("p-1").dtypes)["permits"] == "double"
    assert ws.totals().first()["table_count"] == 2 and ws.inventory().count() == 2
    sql = 'SELECT city, permits FROM "ds_city_a_permits_p-1" WHERE permits > 50000'
    assert ws.sql(sql).count() == 10
    with pytest.raises(InvalidQuery, match="ds_city_a_permits_p-1"):
        ws.sql('SELECT nothing FROM "ds_city_a_permits_p-1"')
    review = ws.review('SELECT * FROM "ds_city_a_permits_p-1" WHERE city = \'x\'')
    assert review["size"].first()["total"] == 0
    assert review["warnings"].first()["warning"] == "no_rows"
    assert review["sources"].first()["status"] == "fresh"
    assert ws.profile("p-1").count() == 3 and ws.quality("p-1").first()["duplicate_rows"] == 0
    assert ws.query("p-1", filters={"city": "c7"}).first()["permits"] == 7007.0


def test_claims(ws):
    sql = 'SELECT * FROM "ds_city_a_permits_p-1"'
    got = ws.validate([
        (sql, 'City "C7" had 7,007 permits.'), (sql, "There were 123,456 permits."), (sql, "Many permits."),
        ("DROP TABLE x", "There were 5."), ('SELECT * FROM "ds_gone"', "There were 5.")]).orderBy("claim_id").collect()
    assert [r["label"] for r in got] == ["PASS", "FAIL", "UNVERIFIABLE", "FAIL", "FAIL"]


def test_null_rows_and_failing_statements_stand_alone(ws):
    table = '"ds_city_a_permits_p-1"'
    got = ws.validate([
        (f"SELECT SUM(permits) AS n FROM {table} WHERE city = 'Z'", "There were 12 permits."),
        (f"SELECT CAST(city AS INT) AS n FROM {table}", "There were 12 permits."),
        (f"SELECT * FROM {table}", 'City "C7" had 7,007 permits.')]).orderBy("claim_id").collect()
    assert [r["label"] for r in got] == ["FAIL", "UNVERIFIABLE", "PASS"]


def test_a_name_belongs_to_one_resource_and_refresh_keeps_its_period(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.land(spark.range(3), "daily-1", "d", "ds_daily", update_frequency="daily")
    with pytest.raises(ValueError, match="another name"):
        store.land(spark.range(1), "daily-2", "d", "ds_daily")
    first = store.registry().first()
    assert store.refresh(lambda r: spark.range(4)).count() == 0
    assert store.refresh(lambda r: spark.range(4), everything=True).first()["status"] == "refreshed"
    again = store.registry().first()
    assert again["row_count"] == 4 and again["expires_at"] - again["downloaded_at"] == first["expires_at"] - first["downloaded_at"]


def test_a_second_resource_gets_a_name_of_its_own(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    ws = Workspace(spark, str(tmp_path / "lake"))
    names = [ws.land(str(tmp_path / "x.csv"), "CSV", f"12345678-{i}", "d", "Same name")["table_name"] for i in range(3)]
    assert len(set(names)) == 3 and all(n.startswith(names[0]) for n in names)
    assert ws.land(str(tmp_path / "x.csv"), "CSV", "12345678-1", "d", "Same name", force=True)["table_name"] == names[1]
    assert ws.sql(f'SELECT * FROM "{names[2]}"').count() == 1


def test_refresh_of_everything_side_by_side(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    for i in range(6):
        ws.store.land(spark.range(2), f"r{i}", "d", f"ds_{i}")

    def load(row):
        if row["resource_id"] == "r3":
            raise OSError("gone")
        return spark.range(5)

    assert ws.refresh(load).count() == 0
    got = {r["resource_id"]: (r["status"], r["row_count"], r["error"]) for r in ws.refresh(load, everything=True).collect()}
    assert got.pop("r3") == ("error", None, "gone") and set(got.values()) == {("refreshed", 5, None)}
    assert {r["resource_id"]: r["row_count"] for r in ws.store.registry().collect()} == {**{f"r{i}": 5 for i in range(6)}, "r3": 2}
    assert ws.clear() == 6 and ws.store.registry().count() == 0


def test_spatial(ws):
    assert [r["zone"] for r in ws.containing("z-1", 5, 1).collect()] == [4]
    assert [r["zone"] for r in ws.nearby("z-1", 5, 3, 112).collect()] == [4]
    assert sorted(r["zone"] for r in ws.in_box("z-1", [4, 1, 6, 1.5]).collect()) == [2, 4, 6]
    with pytest.raises(ValueError, match="latitude"):
        ws.containing("z-1", 1, 100)


def test_free_sql_leaves_the_session_alone(ws):
    table = ws.store.registry().where("resource_id = 'p-1'").first()["table_name"]
    options, views = ws.spark.conf.getAll, {t.name for t in ws.spark.catalog.listTables()}
    assert ws.sql(f'SELECT ST_X(ST_POINT(permits, 1)) AS x FROM "{table}" ORDER BY 1 LIMIT 1').count() == 1
    assert ws.sql(f'SUMMARIZE "{table}"').count() == 3
    assert ws.spark.conf.getAll == options and {t.name for t in ws.spark.catalog.listTables()} == views
    assert not ws.spark.catalog.functionExists("st_point")


def test_removal(ws):
    assert ws.remove("city_a:p-1") and ws.clear() == 1 and ws.totals().first()["table_count"] == 0
