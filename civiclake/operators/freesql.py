"""Free SQL text on registered tables, in the dialect open-data users write."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.functions.sqlfunctions import functions_for, ordered_lists
from civiclake.functions.statements import reject_reason
from civiclake.operators.profile import profile
from civiclake.session import settings

RESULT_CAP = 2000
COMMENTS = r"(?:\s|--[^\n]*\n|/\*.*?\*/)*"
SUMMARIZE = re.compile(COMMENTS + r"summarize\s", re.IGNORECASE | re.DOTALL)
QUERY = re.compile(COMMENTS + r"(?:(?:select|with|from|values)\b|\()", re.IGNORECASE | re.DOTALL)


class InvalidQuery(ValueError):
    """The statement cannot run. ``reason`` is a code: ``semicolons``, ``read-only`` or ``engine``."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def check_sql(sql: str) -> None:
    """Raise unless the text is one read-only statement."""
    reason = reject_reason(sql)
    if reason is not None:
        raise InvalidQuery(reason, sql[:200])


def run_sql(spark: SparkSession, sql: str, cap: int | None = RESULT_CAP) -> DataFrame:
    """Analyse the text and return its (capped) result.

    Names may be quoted with ``"``, and a backslash in a literal is plain text. ``ST_POINT``, ``ST_CONTAINS``, ``ST_DISTANCE``, ``EPOCH``,
    ``JSON_EXTRACT_STRING`` and their like are known (``functions/sqlfunctions.py``), ``STRING_AGG`` takes an ORDER BY, and
    ``SUMMARIZE`` of a table or a query gives its profile. The session is as before once the statement is analysed.
    Without a cap the result is whole, for use inside a larger job.
    """
    check_sql(sql)
    summary = SUMMARIZE.match(sql)
    text = ordered_lists(sql[summary.end():] if summary else sql)
    if summary and not QUERY.match(text):
        text = f"SELECT * FROM {text}"
    with settings(
        spark,
        spark__sql__ansi__enabled="true",
        spark__sql__ansi__doubleQuotedIdentifiers="true",
        spark__sql__parser__escapedStringLiterals="true",
    ), functions_for(spark, text):
        df = spark.sql(text)
    df = profile(df) if summary else df
    return df if cap is None else df.limit(cap)


def truncation_report(df: DataFrame, cap: int = RESULT_CAP) -> DataFrame:
    """One row: all rows, rows returned under the cap, and whether that cuts."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.least("total", F.lit(cap).cast("long")).alias("returned"),
        (F.col("total") > cap).alias("truncated"),
    )
