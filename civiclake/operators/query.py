"""Structured queries, previews, and checks on logged statements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.functions import statements as st
from civiclake.functions.numbers import ntz
from civiclake.operators.ordering import sort_columns


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def drop_internal(df: DataFrame) -> DataFrame:
    """Without the bookkeeping columns, whose names start with ``_``."""
    return df.select(*[_quoted(c) for c in df.columns if not c.startswith("_")])


def matching_rows(df: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows equal to every given value (a list means any of its values)."""
    out = df
    for name, value in (filters or {}).items():
        if value is None:
            out = out.where(_quoted(name).isNull())
        elif isinstance(value, (list, tuple, set)):
            out = out.where(_quoted(name).isin(list(value)))
        else:
            out = out.where(_quoted(name) == value)
    return out


def query_table(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    fields: Sequence[str] | None = None,
    sort: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """A page of matching rows, as many as asked (None: all), in the asked order."""
    rows = matching_rows(drop_internal(df), filters)
    if sort:
        rows = rows.orderBy(*sort_columns(sort))
    if fields:
        rows = rows.select(*[_quoted(c) for c in fields])
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def query_total(df: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """How many rows match in all, beside any page."""
    return matching_rows(df, filters).agg(F.count(F.lit(1)).alias("total"))


def preview(df: DataFrame, rows: int = 10, sort: str | None = None) -> DataFrame:
    """The first rows, as many as asked; with ``sort`` the same ones on every run."""
    out = drop_internal(df)
    if sort:
        out = out.orderBy(*sort_columns(sort))
    return out.limit(rows)


def describe_columns(df: DataFrame, samples: int = 5, sort: str | None = None) -> DataFrame:
    """One row per column: name, type and the values of the first rows as text."""
    shown = drop_internal(df)
    first = preview(shown, samples, sort).withColumn("_row", F.monotonically_increasing_id())
    fields = shown.schema.fields
    cells = first.select("_row", F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
            _quoted(f.name).cast("string").alias("value"),
        )
        for i, f in enumerate(fields)
    ])))
    # At most ``samples`` values per column, however long the table.
    listed = cells.groupBy("position", "name", "type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_row", "value"))), lambda s: s["value"]).alias("sample_values"))
    return listed.select("name", "type", F.filter("sample_values", lambda v: v.isNotNull()).alias("sample_values"), "position")


# --- logged statements -----------------------------------------------------------------

def audit_sql(log: DataFrame, column: str = "sql") -> DataFrame:
    """Add ``verdict``: ``semicolons``, ``read-only`` (rejected) or ``ok``."""
    text = st.uncommented(F.col(column))
    # A plain array holds the cleaned text once, so the pattern runs once per row.
    verdict = F.transform(F.array(text), lambda t: (
        F.when(st.has_open_semicolon(t), "semicolons")
        .when(~st.first_word(t).isin(*st.READ_ONLY_WORDS), "read-only")
        .otherwise("ok")
    ))
    return log.withColumn("verdict", F.get(verdict, F.lit(0)))


def query_warnings(log: DataFrame, stats: DataFrame) -> DataFrame:
    """Warnings on logged queries, one row each.

    ``log``: query_id, sql, result_rows. ``stats``: table_name, row_count, columns.
    The first table named after FROM is the one looked at.
    """
    named = log.withColumn("table_name", F.get(st.table_names(F.col("sql")), F.lit(0))).where(F.col("table_name").isNotNull())
    told = named.join(stats.select("table_name", "row_count", "columns"), "table_name")
    amounts = F.filter("columns", lambda c: c.rlike(st.PER_ROW_COUNT_NAME))
    size = F.format_number("row_count", 0)
    warnings = [
        ("per_row_counts", F.col("sql").rlike(st.COUNT_ALL) & (F.size("amounts") > 0),
         F.concat(F.lit('Some columns may hold counts: '), F.array_join("amounts", ", "),
                  F.lit('. SUM("'), F.get("amounts", F.lit(0)), F.lit('") may be meant instead of COUNT(*).'))),
        ("no_rows", (F.col("result_rows") == 0) & (F.col("row_count") > 0),
         F.concat(F.lit("No rows came back, but the table has "), size, F.lit(". Look at the WHERE and JOIN conditions."))),
        ("few_groups", F.col("result_rows").between(1, 3) & F.col("sql").rlike(st.GROUPED) & (F.col("row_count") > 1000),
         F.concat(F.lit("Only "), F.col("result_rows"), F.lit(" groups from "), size, F.lit(" rows. Look at the GROUP BY columns."))),
    ]
    found = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(code).alias("warning"), text.alias("message"))) for code, condition, text in warnings]))
    return told.withColumn("amounts", amounts).select("query_id", "table_name", F.explode(found).alias("w")).select(
        "query_id", "table_name", "w.warning", "w.message")


def provenance(log: DataFrame, registry: DataFrame, now) -> DataFrame:
    """For every landed table a query names: source, download time, and whether it is fresh."""
    named = log.select("query_id", F.explode(F.array_distinct(st.table_names(F.col("sql")))).alias("table_name"))
    status = (
        F.when(F.col("expires_at").isNull(), "unknown").when(ntz(now) > F.col("expires_at"), "stale").otherwise("fresh"))
    return named.join(registry, "table_name").select(
        "query_id", "table_name", "resource_id",
        F.coalesce(F.date_format("downloaded_at", "yyyy-MM-dd HH:mm:ss"), F.lit("unknown")).alias("downloaded"),
        status.alias("status"),
    )
