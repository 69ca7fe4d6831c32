"""Give text columns that hold numbers a numeric type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from civiclake.functions.numbers import CASTABLE, COMMA_NUMBER, PLAIN_NUMBER, stripped, to_double

SPACE = 1 << 40  # the hash range values are sampled from


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _as_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for the non-NULL cells of the given text columns."""
    return df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _quoted(c).alias("value")) for c in columns]))
    ).where(F.col("value").isNotNull())


def sample_values(df: DataFrame, columns: list[str], sample: int | None) -> DataFrame:
    """Distinct (column, value), at most ``sample`` per column, the same on every run.

    Values are picked by smallest hash. A first pass estimates how many distinct
    values each column has; the second keeps only hashes low enough to leave about
    four samples' worth, so a column of a billion texts shuffles a few hundred.
    """
    cells = _as_rows(df, columns)
    if sample is None:
        return cells.distinct()
    sizes = df.agg(*[F.approx_count_distinct(_quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    def below(i: int):
        share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.greatest(F.col(f"c{i}"), F.lit(1)))
        return F.ceil(F.lit(SPACE) * share).cast("long")

    limits = sizes.select(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), below(i))])).scalar()
    place = W.partitionBy("column").orderBy("hash", "value")
    return (
        cells.withColumn("hash", F.pmod(F.xxhash64("value"), F.lit(SPACE)))
        .where(F.col("hash") < F.element_at(limits, F.col("column")))
        .select("column", "value", "hash").distinct()
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= sample)
        .select("column", "value")
    )


def detect_numeric_strings(df: DataFrame, threshold: float = 0.8, sample: int | None = None) -> DataFrame:
    """One row per text column: how many of its distinct values look numeric.

    All values decide; ``sample`` limits them to that many per column where asked.
    """
    columns = text_columns(df)
    schema = "column string, n_values long, n_plain long, n_comma long, is_numeric boolean, has_commas boolean"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    value = stripped(F.col("value"))
    counted = (
        sample_values(df, columns, sample)
        .withColumn("value", value)
        .where(F.col("value") != "")
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            F.count_if(F.col("value").rlike(PLAIN_NUMBER)).alias("n_plain"),
            F.count_if(F.col("value").rlike(COMMA_NUMBER)).alias("n_comma"),
        )
    )
    return counted.select(
        "*",
        ((F.col("n_plain") + F.col("n_comma")) / F.col("n_values") > threshold).alias("is_numeric"),
        (F.col("n_comma") > 0).alias("has_commas"),
    )


def repair_numeric(df: DataFrame, threshold: float = 0.8, sample: int | None = None) -> DataFrame:
    """Re-type the text columns found numeric to DOUBLE; other values there become NULL.

    The verdicts (one row per text column) come to the driver, because they decide
    the schema; the data itself is then read once, by one projection.
    """
    numeric = {r["column"] for r in detect_numeric_strings(df, threshold, sample).where("is_numeric").collect()}

    def repaired(name: str):
        text = _quoted(name)
        # Each value is judged by itself: commas go where they stand between thousands.
        plain = F.when(stripped(text).rlike(COMMA_NUMBER), F.regexp_replace(text, ",", "")).otherwise(text)
        return to_double(plain).alias(name)

    return df.select(*[repaired(c) if c in numeric else _quoted(c) for c in df.columns])


# Texts that a CSV column may use for "no value".
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def infer_types(df: DataFrame) -> DataFrame:
    """Type an all-text table: whole numbers, other numbers, booleans, else text.

    Missing-value texts become NULL. A whole-number column with gaps is DOUBLE, as is
    a column without any value. Dates stay text. One aggregation decides all columns.
    """
    columns = text_columns(df)
    if not columns:
        return df
    clean = {c: F.when(~_quoted(c).isin(*MISSING), _quoted(c)) for c in columns}

    def every(condition):
        return F.coalesce(F.bool_and(condition), F.lit(True))

    tests = []
    for i, c in enumerate(columns):
        v = clean[c]
        tests += [
            F.count_if(v.isNull()).alias(f"missing{i}"),
            F.count(v).alias(f"n{i}"),
            every(v.rlike(r"^\s*[+-]?\d+\s*$") & v.try_cast("bigint").isNotNull()).alias(f"whole{i}"),
            every(v.rlike(CASTABLE)).alias(f"number{i}"),
            every(v.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"flag{i}"),
        ]
    found = df.agg(*tests).first()

    def typed(i: int, c: str):
        if found[f"n{i}"] == 0:
            return clean[c].try_cast("double")
        if found[f"flag{i}"]:
            return clean[c].try_cast("boolean")
        if found[f"whole{i}"] and found[f"missing{i}"] == 0:
            return clean[c].try_cast("bigint")
        if found[f"number{i}"]:
            return to_double(clean[c])
        return clean[c]

    place = {c: i for i, c in enumerate(columns)}
    return df.select(*[typed(place[c], c).alias(c) if c in place else _quoted(c) for c in df.columns])
