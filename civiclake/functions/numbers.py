"""Column expressions on numbers kept as text, and on time spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number when a text column is examined.
PLAIN_NUMBER = r"^-?\d+\.?\d*$"
COMMA_NUMBER = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"

# What a cast may read: no Java suffixes such as ``1d`` or ``2f``.
CASTABLE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def to_double(text: Column) -> Column:
    """Text to double; NULL where it is not a number."""
    return F.when(text.rlike(CASTABLE), text.try_cast("double"))


def stripped(text: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(text, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, exact to the microsecond, whatever the session zone."""
    span = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return span.cast("interval second").cast("decimal(20,6)")


def ntz(moment) -> Column:
    """A literal moment (text or naive datetime, meaning UTC) as TIMESTAMP_NTZ."""
    return moment if isinstance(moment, Column) else F.lit(str(moment)).cast("timestamp_ntz")
