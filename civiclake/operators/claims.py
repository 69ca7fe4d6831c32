"""Check written claims against query results, many at a time.

Shapes: ``claims`` (claim_id, result_id, claim, and for the full check sql and
started_at), ``results`` (result_id plus any columns), ``registry``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.functions import statements as st
from civiclake.functions.numbers import to_double
from civiclake.operators.query import audit_sql
from civiclake.operators.skew import spread_join
from civiclake.session import full_shuffle

# What is a fact in a claim, and how closely a number must agree.
PERCENTAGE = r"(?U)(\d[\d,]*\.?\d*)\s*%"
NUMBER = r"(?U)(?=\d)(?<![%\w])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+)(?![%\w])"
QUOTED = r"""["']([^"']+)["']"""
RELATIVE = 0.005
ABSOLUTE = 0.5

# Cells of a result that are listed in one row; a larger result is looked up cell by cell.
MOST_LISTED = 250

NUMERIC_KINDS = ("percentage", "integer", "float")


def normal_text(text: Column) -> Column:
    """Lower case with runs of white space as one blank and none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def number_text(column: Column, kind: T.DataType) -> Column:
    """A value as text; doubles without an exponent in the everyday range."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.cast("string")
    size = F.abs(column)
    plain = F.regexp_replace(column.cast("decimal(38,12)").cast("string"), r"0+$", "")
    whole = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    exponent = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(exponent, whole).otherwise(column.cast("string"))


# --- facts --------------------------------------------------------------------------

def facts_in(text: Column) -> tuple[Column, Column, Column]:
    """Raw percentages, numbers and quoted strings of a text, as three arrays.

    Each kind is taken out before the next is looked for. Texts without a percent sign
    or a quote skip the passes that need one.
    """
    nothing = F.array().cast("array<string>")

    def every(source: Column, pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(source, F.lit(pattern), F.lit(group))

    has_percent = text.contains("%")
    has_quote = text.contains('"') | text.contains("'")
    first = F.when(has_percent, F.regexp_replace(text, PERCENTAGE, "")).otherwise(text)
    percentages = F.when(has_percent, every(text, PERCENTAGE)).otherwise(nothing)
    numbers = every(first, NUMBER, 1)
    strings = F.when(has_quote, every(F.regexp_replace(first, NUMBER, ""), QUOTED)).otherwise(nothing)
    return percentages, numbers, strings


def with_fact_list(claims: DataFrame, text: str = "claim", name: str = "facts") -> DataFrame:
    """Add the facts of a text in order: an array of kind, raw text, and number or string."""
    def fact(kind: Column, raw: Column, num: Column, string: Column) -> Column:
        return F.struct(kind.alias("kind"), raw.alias("raw"), num.cast("double").alias("num"), string.cast("string").alias("str"))

    def value(raw: Column) -> Column:
        return F.regexp_replace(raw, r"(?U)[,%\s]", "").try_cast("double")

    def whole(raw: Column) -> Column:
        return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")

    none = F.lit(None)
    raws = claims.select(*claims.columns, F.struct(*[
        c.alias(n) for n, c in zip(("percentages", "numbers", "strings"), facts_in(F.col(text)))]).alias("_raw"))
    found = F.concat(
        F.transform("_raw.percentages", lambda m: fact(F.lit("percentage"), m, value(m), none)),
        F.transform("_raw.numbers", lambda m: fact(F.when(m.contains("."), "float").otherwise("integer"), m, whole(m), none)),
        F.transform("_raw.strings", lambda m: fact(F.lit("string"), m, none, F.substr(m, F.lit(2), F.length(m) - 2))),
    )
    return raws.select(*claims.columns, found.alias(name))


def extract_facts(claims: DataFrame, text: str = "claim", keep_empty: bool = False) -> DataFrame:
    """One row per fact: position, kind, raw text, and its number or string.

    Percentages are taken out first, then other numbers, then quoted strings. With
    ``keep_empty`` a claim without facts keeps one row of NULLs.
    """
    spread = F.posexplode_outer if keep_empty else F.posexplode
    return with_fact_list(claims, text, "_facts").select(*claims.columns, spread("_facts").alias("position", "fact")).select(
        *claims.columns, "position", "fact.*")


def value_index(results: DataFrame, key: str = "result_id") -> DataFrame:
    """Distinct cells of every result: column, number (if it is one) and normal text."""
    cells = []
    for f in results.schema.fields:
        if f.name == key:
            continue
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)):
            num = to_double(col)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num = col.cast("double")
        else:
            num = F.lit(None).cast("double")
        cells.append(F.struct(
            F.lit(f.name).alias("column"), num.alias("num"), normal_text(number_text(col, f.dataType)).alias("str")))
    return results.select(key, F.inline(F.array(*cells))).where(F.col("str").isNotNull()).distinct()


def row_markers(results: DataFrame, key: str = "result_id") -> DataFrame:
    """One index entry per result with any row, so that rows of NULLs alone still count as rows."""
    nothing = F.lit(None).cast("double")
    return results.select(key).distinct().select(key, F.lit("").alias("column"), nothing.alias("num"), F.lit("").alias("str"))


# --- matching -----------------------------------------------------------------------

def close(a: Column, b: Column) -> Column:
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= F.greatest(F.lit(RELATIVE) * larger, F.lit(ABSOLUTE))


def with_slot(df: DataFrame) -> DataFrame:
    """Add ``slot``: the place of ``num`` on a number line cut to fit the tolerance.

    The tolerance reaches one slot either way, and no further. Up to 100 it is the
    absolute one and slots are even; beyond, it is relative and slots are even on the
    log scale. Slots are a little wider than the reach, and narrower than the whole
    tolerance interval. Numbers too large for the scale have no slot.
    """
    turn = ABSOLUTE / RELATIVE
    beyond = F.ln(F.col("_size") / turn) / -math.log(1 - RELATIVE) + turn / ABSOLUTE
    scaled = F.when(F.col("_size") <= turn, F.col("_size") / ABSOLUTE).when(F.col("_size") < 1e300, beyond)
    return (
        df.withColumn("_size", F.abs("num"))
        .withColumn("slot", F.floor(F.signum("num") * scaled / 1.05).cast("long")).drop("_size")
    )


def match_tolerance(probes: DataFrame, index: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, num, column) for each distinct probe number that some cell is close to.

    The cells of a slot are reduced to their least and greatest. A tolerance interval
    is wider than a slot, so a slot lies inside it or is cut by one end only: the two
    extremes decide, and no slot can grow into many candidates. The exploded side is many times
    its estimate and the slots are as many as the cells, so neither is broadcast.
    """
    cells = (
        with_slot(index).where(F.col("slot").isNotNull()).groupBy(key, "slot")
        .agg(F.min(F.struct("num", "column")).alias("least"), F.max(F.struct("num", "column")).alias("most"))
    )
    distinct = with_slot(probes.select(key, "num").distinct()).where(F.col("slot").isNotNull())
    tried = distinct.withColumn("slot", F.explode(F.array(*[F.col("slot") + step for step in (-1, 0, 1)])))
    column = F.when(close(F.col("least.num"), F.col("num")), F.col("least.column")).when(
        close(F.col("most.num"), F.col("num")), F.col("most.column"))
    return (
        tried.join(cells.hint("merge"), [key, "slot"]).withColumn("column", column).where(F.col("column").isNotNull())
        .groupBy(key, "num").agg(F.min("column").alias("column"))
    )


def match_facts(facts: DataFrame, index: DataFrame, key: str = "result_id") -> DataFrame:
    """Facts with ``found_in``: a column of their result that holds them, else NULL.

    Integers must be equal; floats close; percentages close as they stand or divided
    by 100; strings equal after normalising.
    """
    own = list(facts.columns)
    return _look_up(_probes(facts), index, key, facts).groupBy(*own).agg(F.min("column").alias("found_in"))


def _probes(facts: DataFrame, extra: Column | None = None) -> DataFrame:
    """Facts times what to look for in the index: (way, at, wanted).

    A close number is looked for in its own slot and in those beside it, and a
    percentage as it stands and divided by 100.
    """
    nothing = F.lit(None).cast("double")
    first = with_slot(facts).withColumnRenamed("slot", "_slot1")
    hundredth = with_slot(first.withColumns({"_num": F.col("num"), "num": F.col("num") / 100})).withColumnRenamed("slot", "_slot2")
    both = hundredth.withColumns({"_part": F.col("num"), "num": F.col("_num")}).withColumn("_text", normal_text(F.col("str")))

    def probe(way: str, at: Column, wanted: Column = nothing) -> Column:
        return F.struct(F.lit(way).alias("way"), at.cast("string").alias("at"), wanted.alias("wanted"))

    def beside(name: str, wanted: str) -> list[Column]:
        return [probe("near", F.col(name) + step, F.col(wanted)) for step in (-1, 0, 1)]

    kind = F.col("kind")
    by_kind = (
        F.when(kind == "integer", F.array(probe("equal", F.col("num"))))
        .when(kind == "float", F.array(*beside("_slot1", "num")))
        .when(kind == "percentage", F.array(*beside("_slot1", "num"), *beside("_slot2", "_part")))
        .when(kind == "string", F.array(probe("text", F.col("_text"))))
    )
    if extra is not None:
        rows = F.when(extra, F.array(probe("rows", F.lit("")))).otherwise(F.array().cast("array<struct<way:string,at:string,wanted:double>>"))
        by_kind = F.concat(F.coalesce(by_kind, F.array().cast("array<struct<way:string,at:string,wanted:double>>")), rows)
    return both.select(*facts.columns, F.inline(by_kind))


def _look_up(probes: DataFrame, index: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Left join of probes with the index, reduced to one row per (key, way, at).

    A probe meets at most one index row, so the join keeps the size of its left side
    however often a value or a result is asked for. Results that many rows of ``asked`` are about
    are dealt over several tasks, and their reduced index rows with them. ``column`` is where the probe was found, else NULL.
    """
    num = F.col("num")

    def place(way: str, at: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(way).alias("way"), at.cast("string").alias("at")))

    places = F.array_compact(F.array(
        place("equal", num, num.isNotNull()),
        place("near", F.col("slot"), F.col("slot").isNotNull()),
        place("text", F.col("str"), F.col("str") != ""),
        place("rows", F.lit(""), F.lit(True)),
    ))
    held = (
        with_slot(index).select(key, "column", "num", F.inline(places))
        .groupBy(key, "way", "at")
        .agg(F.min(F.struct("num", "column")).alias("least"), F.max(F.struct("num", "column")).alias("most"))
    )
    column = F.when((F.col("way") != "near") | close(F.col("least.num"), F.col("wanted")), F.col("least.column")).when(
        close(F.col("most.num"), F.col("wanted")), F.col("most.column"))
    met = spread_join(probes, held, [key, "way", "at"], heavy_on=[key], counted=asked, merge=True).withColumn("column", column)
    return met.drop("way", "at", "wanted", "least", "most")


def _listed(index: DataFrame, key: str) -> DataFrame:
    """key, is_large and the ``cells`` (num, at, str) of each result; an empty list for a large one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))  # any cells: a list that is cut is not used
    some = index.withColumn("_place", place).where(F.col("_place") <= MOST_LISTED + 1)
    cell = F.struct("num", F.col("num").cast("string").alias("at"), "str")
    listed = some.groupBy(key).agg(F.collect_list(cell).alias("cells"))
    large = F.size("cells") > MOST_LISTED
    return listed.select(key, large.alias("is_large"), F.when(large, F.slice("cells", 1, 0)).otherwise(F.col("cells")).alias("cells"))


def _in_cells(fact: Column, cells: Column) -> Column:
    """Whether a list of cells holds a fact, by the rules of ``match_facts``."""
    def near(wanted: Column) -> Column:
        # Numbers too large for a slot are close to nothing.
        return F.exists(cells, lambda c: (F.abs(c["num"]) < 1e300) & (F.abs(wanted) < 1e300) & close(c["num"], wanted))

    kind = fact["kind"]
    return (
        F.when(kind == "integer", F.exists(cells, lambda c: c["at"] == fact["num"].cast("string")))
        .when(kind == "float", near(fact["num"]))
        .when(kind == "percentage", near(fact["num"]) | near(fact["num"] / 100))
        .when(kind == "string", F.get(F.transform(F.array(normal_text(fact["str"])), lambda t: (t != "") & F.exists(cells, lambda c: c["str"] == t)), F.lit(0)))
    )


# --- verdicts -----------------------------------------------------------------------

def claim_verdicts(claims: DataFrame, index: DataFrame, key: str = "result_id", longest: int | None = None) -> DataFrame:
    """Per claim: facts, facts found, and ``claim_valid`` (true, false or NULL).

    NULL: no facts, nothing in the result, a claim of more than ``longest`` characters (any length if None), or only numbers missing
    while something else was found (they may be derived). A claim whose statement the
    audit rejects is false. Claims are read once: a probe for the mere presence of rows
    keeps those without facts.
    """
    usable = F.lit(True) if longest is None else F.length("claim") <= longest
    audited = audit_sql(claims) if "sql" in claims.columns else claims.withColumn("verdict", F.lit("ok"))
    texts = audited.select(
        "claim_id", key, F.when(usable, F.col("claim")).otherwise("").alias("claim"), usable.alias("usable"),
        (F.col("verdict") == "ok").alias("allowed"))
    # Results of a common size are one row each, which meets its claims whole. Only the claims on larger ones, if there are any,
    # are taken apart and looked up fact by fact.
    listed = _listed(index, key)
    large = listed.where("is_large").select(key)
    sizes = index.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    any_large = sizes.agg(F.coalesce(F.max("n") > MOST_LISTED, F.lit(False))).scalar()
    of_large = lambda rows: rows.where(any_large).join(large, key, "left_semi")
    told = with_fact_list(texts).drop("claim").withColumn("facts", F.transform("facts", lambda f: F.struct(f["kind"].alias("kind"), f["num"].alias("num"), f["str"].alias("str"))))
    met = spread_join(told, listed, [key], counted=texts, merge=True).where(~F.coalesce("is_large", F.lit(False)))
    met = met.select(
        "claim_id", key, "usable", "allowed", F.col("cells").isNotNull().alias("rows_found"),
        F.posexplode_outer(F.transform("facts", lambda f: F.struct((f["kind"] == "string").alias("is_string"), _in_cells(f, F.col("cells")).alias("found")))).alias("position", "fact"))
    by_list = met.select("claim_id", key, "position", "usable", "allowed", "fact.is_string", F.coalesce("fact.found", F.lit(False)).alias("found"), "rows_found")
    facts = extract_facts(of_large(texts), keep_empty=True).drop("claim", "raw")
    probes = _probes(facts, extra=F.coalesce(F.col("position"), F.lit(0)) == 0)
    found = F.col("column").isNotNull()
    # The rows probe carries the first fact's place, so it is told apart by its way.
    asked = probes.withColumn("about_rows", F.col("way") == "rows")
    by_cell = _look_up(asked, of_large(index), key, of_large(texts)).select(
        "claim_id", key, "position", "usable", "allowed", (F.col("kind") == "string").alias("is_string"), (found & ~F.col("about_rows")).alias("found"), (F.col("about_rows") & found).alias("rows_found"))
    # A fact first, from its several probes, then the claim, where its facts are: one shuffle for both.
    facts_met = by_list.unionByName(by_cell).repartition(full_shuffle(claims.sparkSession), "claim_id", key).groupBy("claim_id", key, "position").agg(
        F.first("usable").alias("usable"), F.first("allowed").alias("allowed"), F.first("is_string").alias("is_string"),
        F.bool_or("found").alias("found"), F.bool_or("rows_found").alias("rows_found"))
    counted = facts_met.groupBy("claim_id", key).agg(
        F.first("usable").alias("usable"), F.first("allowed").alias("allowed"),
        F.coalesce(F.max("position") + 1, F.lit(0)).alias("n_facts"),
        F.count_if("found").cast("int").alias("n_found"),
        F.coalesce(F.bool_or("rows_found"), F.lit(False)).alias("has_rows"),
        F.bool_or(F.col("is_string") & ~F.col("found")).alias("string_missing"),
    )
    verdict = (
        F.when(~F.col("usable"), F.lit(None).cast("boolean"))
        .when(~F.col("allowed"), False)
        .when(~F.col("has_rows") | (F.col("n_facts") == 0), F.lit(None).cast("boolean"))
        .when(F.col("n_found") == F.col("n_facts"), True)
        .when((F.col("n_found") > 0) & ~F.coalesce("string_missing", F.lit(False)), F.lit(None).cast("boolean"))
        .otherwise(False)
    )
    return counted.select("claim_id", key, "n_facts", "n_found", "usable", verdict.alias("claim_valid"))


def data_stability(log: DataFrame, registry: DataFrame, key: str = "query_id") -> DataFrame:
    """Per query: ``stable`` is true if every table it names was landed before it started.

    NULL if it names none; ``unknown_tables`` and ``refreshed_tables`` count the causes.
    """
    named = log.select(key, "started_at", F.explode(st.table_names(F.col("sql"), st.FROM_OR_JOIN_TABLE)).alias("table_name"))
    landed = registry.select("table_name", "downloaded_at")
    counted = (
        named.distinct().join(landed, "table_name", "left").groupBy(key).agg(
            F.count_if(F.col("downloaded_at").isNull()).alias("unknown_tables"),
            F.count_if(F.col("downloaded_at") > F.col("started_at")).alias("refreshed_tables"),
        )
    )
    return log.select(key).join(counted, key, "left").select(
        key, (F.col("unknown_tables") + F.col("refreshed_tables") == 0).alias("stable"), "unknown_tables", "refreshed_tables")


def validate_claims(
    claims: DataFrame, index: DataFrame, registry: DataFrame, key: str = "result_id", longest: int | None = None
) -> DataFrame:
    """The combined verdict of each claim: PASS, FAIL or UNVERIFIABLE, with a reason code and counts."""
    verdicts = claim_verdicts(claims, index, key, longest)
    long = ~F.col("usable")
    stable = data_stability(claims.withColumnRenamed("claim_id", "query_id"), registry).select(
        F.col("query_id").alias("claim_id"), "stable")
    wrong = F.coalesce(~F.col("claim_valid"), F.lit(False))
    moved = F.coalesce(~F.col("stable"), F.lit(False))
    right = F.coalesce(F.col("claim_valid"), F.lit(False))
    valid = F.when(long, F.lit(None).cast("boolean")).when(wrong | moved, False).when(right, True)
    reason = (
        F.when(long, "length").when(wrong & moved, "facts_and_tables").when(wrong, "facts").when(moved, "tables")
        .when(right, "confirmed").otherwise("undecided")
    )
    text = F.concat(
        reason, F.lit(": facts found "), F.coalesce(F.col("n_found"), F.lit(0)), F.lit(" of "), F.coalesce(F.col("n_facts"), F.lit(0)),
        F.lit(", tables unchanged "), F.coalesce(F.col("stable").cast("string"), F.lit("unknown")))
    return (
        verdicts.join(stable, "claim_id", "left")
        .withColumns({"valid": valid, "summary": text})
        .withColumn("label", F.when(F.col("valid").isNull(), "UNVERIFIABLE").when(F.col("valid"), "PASS").otherwise("FAIL"))
        .select("claim_id", key, "n_facts", "n_found", "claim_valid", "stable", "valid", "label", "summary")
    )
