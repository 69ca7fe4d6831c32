"""When landed tables expire, and how fresh datasets are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions.numbers import ntz, seconds_between, stripped

# Days until data with this update frequency counts as old.
FREQUENCY_DAYS = {
    "daily": 2,
    "weekly": 10,
    "monthly": 45,
    "quarterly": 120,
    "biannually": 200,
    "yearly": 400,
    "as_required": 365,
    "on_demand": 365,
}
DEFAULT_DAYS = 30

ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def frequency_days(frequency: Column) -> Column:
    """Days for an exact frequency word, NULL for any other."""
    pairs = [F.lit(part) for pair in FREQUENCY_DAYS.items() for part in pair]
    return F.element_at(F.create_map(*pairs), frequency)


def days_after(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days.cast("int"))


def with_expiry(df: DataFrame, landed: str = "downloaded_at", frequency: str = "update_frequency") -> DataFrame:
    """Add ``expires_at`` from the update frequency (any case, padded or not)."""
    word = F.lower(stripped(F.coalesce(F.col(frequency), F.lit(""))))
    days = F.coalesce(frequency_days(word), F.lit(DEFAULT_DAYS))
    return df.withColumn("expires_at", days_after(F.col(landed), days))


def with_staleness(df: DataFrame, now) -> DataFrame:
    """Set the effective ``expires_at`` and add ``is_stale`` and ``age_hours``.

    All three are NULL for a row without a download time.
    """
    landed = F.col("downloaded_at")
    expires = F.when(
        landed.isNotNull(), F.coalesce(F.col("expires_at"), days_after(landed, F.lit(DEFAULT_DAYS))))
    hours = F.round(seconds_between(landed, ntz(now)).cast("double") / 3600, 1)
    return df.withColumns({"expires_at": expires, "is_stale": ntz(now) > expires, "age_hours": hours})


def parse_moment(text: Column) -> Column:
    """ISO text as micros since 1970, UTC where no zone is given; NULL if not ISO."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), text)
    dated = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.when(text.rlike(ISO_MOMENT), F.try_to_timestamp(F.coalesce(zoned, dated))))


def check_freshness(datasets: DataFrame, now) -> DataFrame:
    """Days since each dataset changed, against what its frequency promises.

    ``days_since_update`` is NULL for unreadable dates and ``is_stale`` is NULL when
    either side is unknown. The frequency word must match exactly here.
    """
    now_text = F.date_format(ntz(now), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    micros = parse_moment(now_text) - parse_moment(F.col("metadata_modified"))
    days = F.floor(micros / F.lit(86_400_000_000))
    return datasets.select(
        "portal", "id", "title", "update_frequency", F.col("metadata_modified").alias("last_modified"), "current_as_of",
        days.alias("days_since_update"), (days > frequency_days(F.col("update_frequency"))).alias("is_stale"),
    )
