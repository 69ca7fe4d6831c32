"""The versioned list of folders: two writers, compaction, refusal, and whole versions for readers."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from civiclake.sources import manifest as mf
from civiclake.sources.store import Store


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mf, "COMPACT", 4)
    folder = str(tmp_path / "a b%")
    writers = [mf.Manifest(spark, folder, "id long, who string") for _ in range(2)]
    assert writers[0].read().count() == 0 and writers[0].version() == 0

    def write(n):
        return writers[n % 2].add(spark.range(n, n + 1).select("id", F.lit(f"w{n % 2}").alias("who")))

    with ThreadPoolExecutor(6) as pool:
        versions = sorted(pool.map(write, range(14)))
    assert versions == list(range(1, 15))
    last = mf.Manifest(spark, folder, "id long, who string")
    assert sorted(r["id"] for r in last.read().collect()) == list(range(14))
    assert len(last.folders()) <= 5
    for version in (1, 7, 13):  # an old version stays whole
        assert last.read(version).count() == version


def test_a_check_sees_what_another_writer_put_first(spark, tmp_path):
    one, two = (mf.Manifest(spark, str(tmp_path), "id long") for _ in range(2))
    seen = []

    def only_one(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            two.add(spark.range(1))  # another writer, between the look and the commit
        elif rows.count():
            raise ValueError("taken")

    with pytest.raises(ValueError, match="taken"):
        one.add(spark.range(5, 6), only_one)
    assert seen == [0, 1] and [r["id"] for r in one.read().collect()] == [0]


def test_two_stores_cannot_take_one_name(spark, tmp_path):
    stores = [Store(spark, str(tmp_path)) for _ in range(2)]

    def land(i):
        try:
            stores[i].land(spark.range(i + 1), f"r{i}", "d", "ds_same")
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(land, range(2))) == [False, True]
    assert stores[0].registry().count() == 1
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: stores[i % 2].land(spark.range(i), f"x{i}", "d", f"ds_{i}"), range(8)))
    assert {r["resource_id"]: r["row_count"] for r in stores[1].registry().where("resource_id like 'x%'").collect()} == {f"x{i}": i for i in range(8)}
