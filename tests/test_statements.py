"""Which statements pass the audit, on the driver and in a log."""

import pytest

from civiclake.operators.freesql import InvalidQuery, check_sql, run_sql, truncation_report
from civiclake.operators.query import audit_sql, provenance, query_warnings

CASES = [
    ("SELECT 1", "ok"),
    ("SELECT 1; DROP TABLE x", "semicolons"),
    ("SELECT 'a;b'", "ok"),
    ("SELECT 'O''Brien'; DROP TABLE x", "semicolons"),
    ("SELECT 'O''Brien'", "ok"),
    (r"SELECT '\'; DROP TABLE x", "semicolons"),
    ("SELECT 'a', 'b'", "ok"),
    ("SELECT 'a', 'b'; DROP TABLE x", "semicolons"),
    ("SELECT ''", "ok"),
    ("SELECT 'open ; literal", "ok"),
    ("select * from t", "ok"),
    ("WITH c AS (SELECT 1) SELECT * FROM c", "ok"),
    ("EXPLAIN SELECT * FROM t", "ok"),
    ("DESCRIBE t", "ok"),
    ("SHOW TABLES", "ok"),
    ("PRAGMA table_info('t')", "ok"),
    ("SUMMARIZE SELECT * FROM t", "ok"),
    ("DROP TABLE t", "read-only"),
    ("DELETE FROM t", "read-only"),
    ("INSERT INTO t VALUES (1)", "read-only"),
    ("UPDATE t SET x = 1", "read-only"),
    ("CREATE TABLE t (id INT)", "read-only"),
    ("/* harmless */ DROP TABLE x", "read-only"),
    ("-- just a comment\nDROP TABLE x", "read-only"),
    ("SELECT 1 --'\n; DROP TABLE x", "semicolons"),
    ("SELECT 1 /* ' */ ; DROP TABLE x", "semicolons"),
    ("", "read-only"),
    ("SELECT '" + "a''" * 20000 + "'", "ok"),
]


def test_audit_column(spark):
    log = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(CASES)], "i int, sql string")
    got = {r["i"]: r["verdict"] for r in audit_sql(log).collect()}
    assert [got[i] for i in range(len(CASES))] == [v for _, v in CASES]


@pytest.mark.parametrize("sql,verdict", CASES)
def test_check_sql(sql, verdict):
    if verdict == "ok":
        check_sql(sql)
    else:
        with pytest.raises(InvalidQuery, match="(?i)" + verdict):
            check_sql(sql)


def test_writes_behind_with_are_refused():
    with pytest.raises(InvalidQuery):
        check_sql("WITH c AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM c")


def test_run_sql_dialect_and_cap(spark):
    spark.createDataFrame([(i, "a\\nb") for i in range(5000)], '`row id` int, note string').createOrReplaceTempView("ds_big")
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    df = run_sql(spark, 'SELECT "row id" FROM "ds_big" WHERE note = \'a\\nb\'')
    assert df.count() == 2000
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    report = truncation_report(run_sql(spark, 'SELECT * FROM "ds_big"', cap=None)).first()
    assert (report["total"], report["returned"], report["truncated"]) == (5000, 2000, True)
    short = truncation_report(run_sql(spark, 'SELECT * FROM "ds_big" LIMIT 2', cap=None)).first()
    assert (short["total"], short["truncated"]) == (2, False)


def test_warnings(spark):
    log = spark.createDataFrame([
        (1, 'SELECT COUNT(*) FROM "t_counts"', 1),
        (2, 'SELECT * FROM "t_people" WHERE name = \'nobody\'', 0),
        (3, 'SELECT category, COUNT(*) FROM "t_groups" GROUP BY category', 2),
        (4, 'SELECT * FROM "t_people"', 4),
        (5, 'SELECT * FROM "t_unknown"', 0),
    ], "query_id int, sql string, result_rows int")
    stats = spark.createDataFrame([
        ("t_counts", 3, ["region", "No_of_Exceedances"]), ("t_people", 4, ["name", "age"]), ("t_groups", 3000, ["category", "value"]),
    ], "table_name string, row_count long, columns array<string>")
    got = {(r["query_id"], r["warning"]): r["message"] for r in query_warnings(log, stats).collect()}
    assert set(got) == {(1, "per_row_counts"), (2, "no_rows"), (3, "few_groups")}
    assert 'SUM("No_of_Exceedances")' in got[1, "per_row_counts"]
    assert "3,000" in got[3, "few_groups"]


def test_provenance(spark):
    log = spark.createDataFrame([(1, 'SELECT * FROM "a" JOIN "b" ON 1 = 1'), (2, 'select 1 from "b" where x in (select y from "c")')], "query_id int, sql string")
    registry = spark.createDataFrame(
        [("a", "ra", "2024-01-01 10:00:00.5", "2024-02-01 00:00:00"), ("b", "rb", None, None), ("c", "rc", "2024-01-01 00:00:00", "2025-02-01 00:00:00")],
        "table_name string, resource_id string, d string, e string",
    ).selectExpr("table_name", "resource_id", "cast(d as timestamp_ntz) downloaded_at", "cast(e as timestamp_ntz) expires_at")
    got = {(r["query_id"], r["resource_id"]): (r["downloaded"], r["status"]) for r in provenance(log, registry, "2024-06-01 00:00:00").collect()}
    assert got == {
        (1, "ra"): ("2024-01-01 10:00:00", "stale"), (2, "rb"): ("unknown", "unknown"), (2, "rc"): ("2024-01-01 00:00:00", "fresh")}
