"""Every query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from civiclake.plans import SUITES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    out = [tuple(value(r[i]) for i in places) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = ordered(df.columns, df.collect())
    rel = duck.execute(ORACLES[name])
    want = ordered([d[0] for d in rel.description], rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["n_name", "order_count", "total_price", "avg_price"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    own = {name for suite in SUITES for name in suite.queries}
    assert own == set(ORACLES) & own
