"""Column expressions and checks on SQL statement text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a read-only statement may start with.
READ_ONLY_WORDS = ("select", "with", "explain", "describe", "show", "pragma", "summarize")

# Patterns on statement text.
COMMENT = r"(?s)/\*.*?\*/|--[^\n]*\n?"
LITERAL = r"'(?:[^']|'')*+(?:'|\z)"
FROM_TABLE = r'(?i)FROM\s+"([^"]+)"'
FROM_OR_JOIN_TABLE = r'(?i)(?:FROM|JOIN)\s+"([^"]+)"'
COUNT_ALL = r"(?i)\bCOUNT\s*\(\s*\*\s*\)"
GROUPED = r"(?i)\bGROUP\s+BY\b"
PER_ROW_COUNT_NAME = r"(?i)(count|quantity|number|no_of|total|amount|exceedances|num_)"

WRITES_AFTER_WITH = re.compile(r"(?is)\b(insert\s+(into|overwrite)|merge\s+into|delete\s+from|update\s+\w+\s+set)\b")


def reject_reason(sql: str) -> str | None:
    """``semicolons``, ``read-only`` or None for one statement on the driver."""
    text = re.sub(COMMENT, "", sql).strip()
    bare = re.sub(r"'(?:[^']|'')*+(?:'|\Z)", "''", text)
    if ";" in bare:
        return "semicolons"
    first = text.split(None, 1)[0].lower() if text else ""
    if first not in READ_ONLY_WORDS or WRITES_AFTER_WITH.search(bare):
        return "read-only"
    return None


def uncommented(sql: Column) -> Column:
    return F.trim(F.regexp_replace(sql, F.lit(COMMENT), F.lit("")))


def has_open_semicolon(sql: Column) -> Column:
    """True if a ``;`` stands outside single-quoted literals (``''`` escapes)."""
    return F.contains(F.regexp_replace(sql, F.lit(LITERAL), F.lit("")), F.lit(";"))


def first_word(sql: Column) -> Column:
    return F.lower(F.regexp_extract(sql, r"^\s*(\S+)", 1))


def table_names(sql: Column, pattern: str = FROM_TABLE) -> Column:
    """Names quoted after FROM (or JOIN), in order of appearance."""
    return F.regexp_extract_all(sql, F.lit(pattern), F.lit(1))
