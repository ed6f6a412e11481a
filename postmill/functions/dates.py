"""Posting dates: absolute, relative and free text, always against an explicit clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.core import nonempty, text

# Shape of the text -> format it is read with.
DATE_FORMATS = [
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
]
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
RELATIVE = r"^(\d+)\s+(hour|day|week|month|year)s?\s+ago$"


def with_posted(
    df: DataFrame, raw: Column, as_of: Column, ts: str = "posted_ts", days: str = "relative_days"
) -> DataFrame:
    """Add the timestamp of a posting-date text and its age in whole days.

    Reads known absolute formats, '<n> units ago', today and yesterday. Text that is none of
    these has no timestamp. The age of a dated text never goes below zero.
    """
    shaped = df.withColumn("_raw", text(raw)).withColumn(
        "_low", F.lower("_raw")
    )
    ago = F.col("_low").endswith(" ago")
    posted_on = F.regexp_replace(F.col("_raw"), r"(?i)^posted on\s+", "")
    shaped = shaped.withColumns(
        {
            "_abs": F.when(F.col("_low").startswith("posted on"), posted_on).otherwise(F.col("_raw")),
            "_n": F.when(ago, nonempty(F.regexp_extract("_low", RELATIVE, 1)).try_cast("bigint")),
            "_unit": F.when(ago, F.regexp_extract("_low", RELATIVE, 2)).otherwise(""),
        }
    )
    low, n, unit = F.col("_low"), F.col("_n"), F.col("_unit")
    # Counts of more than nine digits are no ages.
    n = F.when(n < 1_000_000_000, n)
    per_day = F.when(unit == "year", 365).when(unit == "month", 30).when(unit == "week", 7).otherwise(1).cast("bigint")
    read = F.when(F.col("_abs").rlike(ISO_SHAPE), F.col("_abs").try_cast("timestamp"))
    for shape, fmt in DATE_FORMATS:
        read = read.when(F.col("_abs").rlike(shape), F.try_to_timestamp(F.initcap("_abs"), F.lit(fmt)))
    # Ages beyond the calendar (before the year 100 or so) keep their days and have no timestamp.
    near = F.when(n * per_day <= 1900 * 365, n).cast("int")
    back = F.make_interval(
        years=F.when(unit == "year", near).otherwise(0),
        months=F.when(unit == "month", near).otherwise(0),
        weeks=F.when(unit == "week", near).otherwise(0),
        days=F.when(unit == "day", near).when(low == "yesterday", 1).otherwise(0),
        hours=F.when(unit == "hour", near).otherwise(0),
    )
    relative = (unit != "") | low.isin("today", "yesterday")
    per_unit = (
        F.when(unit == "day", n)
        .when(unit == "week", n * 7)
        .when(unit == "month", n * 30)
        .when(unit == "year", n * 365)
        .when(unit == "hour", F.floor(n / 24))
        .when(low == "today", 0)
        .when(low == "yesterday", 1)
    )
    out = shaped.withColumn(ts, F.coalesce(read, F.when(relative, as_of - back)))
    age = F.greatest(F.lit(0).cast("bigint"), whole_days(F.col(ts), as_of))
    return out.withColumn(
        days, F.when(F.col(ts).isNotNull(), age).otherwise(per_unit.cast("bigint"))
    ).drop("_raw", "_abs", "_low", "_n", "_unit")


def whole_days(ts: Column, as_of: Column) -> Column:
    """floor((as_of - ts) in days); negative for the future."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86400000000)).cast("bigint")


def freshness_days(posted: Column, updated: Column, as_of: Column) -> Column:
    """Whole days since posting, else since update; null when unknown or in the future."""
    days = whole_days(F.coalesce(posted, updated), as_of)
    return F.when(days >= 0, days)


def freshness_points(days: Column) -> Column:
    return (
        F.when(days.isNull(), 0)
        .when(days <= 3, 10)
        .when(days <= 7, 6)
        .when(days <= 14, 2)
        .when(days <= 30, -4)
        .when(days <= 45, -8)
        .otherwise(-12)
    )


def freshness_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "freshness unknown")
        .when(days <= 3, "very fresh posting")
        .when(days <= 7, "fresh posting")
        .when(days <= 14, "recent posting")
        .when(days <= 30, "older posting")
        .when(days <= 45, "stale posting")
        .otherwise("very stale posting")
    )


# View windows and the days they span.
POSTED_WINDOWS = {"24h": 1, "3d": 3, "1w": 7, "2w": 14, "1m": 30}
# Posting-age codes of search criteria.
DATE_POSTED_DAYS = {"1d": 1, "3d": 3, "1w": 7, "2w": 14, "1m": 30}


def in_posted_window(ts: Column, window: str, as_of: Column) -> Column:
    days = POSTED_WINDOWS.get(window)
    if days is None:
        return F.lit(True)
    return F.coalesce(whole_days(ts, as_of) <= days, F.lit(False))
