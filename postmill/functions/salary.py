"""Three salary readings that must stay apart: range, floor and maximum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.core import half_up, nonempty

RANGE_PATTERN = r"\$?\s*\d[\d,]*(?:\.\d+)?\s*[kKmM]?"
FLOOR_PATTERN = r"\$?(\d{2,3})(?:,\d{3})?"
MAX_PATTERN = r"([0-9]+(?:[.,][0-9]{3})*(?:\.[0-9]+)?)(\s*k)?"


def _range_amounts(t: Column) -> Column:
    def amount(piece: Column) -> Column:
        number = F.regexp_replace(piece, r"[^0-9.]", "").try_cast("double")
        unit = F.lower(F.right(piece, F.lit(1)))
        scale = F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1)
        return half_up(number * scale).cast("bigint")

    found = F.regexp_extract_all(t, F.lit(RANGE_PATTERN), F.lit(0))
    positive = F.filter(F.transform(found, amount), lambda x: x > 0)
    # Lowest and highest in one pass; a second array_min/array_max would parse twice.
    start = F.struct(F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
    return F.aggregate(
        positive,
        start,
        lambda acc, x: F.struct(
            F.least(acc["lo"], x).alias("lo"), F.greatest(acc["hi"], x).alias("hi")
        ),
    )


def salary_range(t: Column) -> Column:
    """struct(raw_text, range struct(lo, hi)) of normalised text."""
    return F.struct(
        F.coalesce(nonempty(t), F.lit("unknown")).alias("raw_text"),
        _range_amounts(t).alias("annual_usd"),
    )


def salary_floor(c: Column) -> Column:
    """First two or three digit run, in thousands when it is below 1000."""
    digits = F.regexp_replace(F.regexp_extract(c, FLOOR_PATTERN, 0), r"[^0-9]", "")
    # A failed cast costs an exception, so text without digits goes in as null.
    value = nonempty(digits).try_cast("bigint")
    return F.when(value < 1000, value * 1000).otherwise(value)


def salary_max(c: Column) -> Column:
    """Largest amount in the text, 0 when there is none."""

    def amount(piece: Column) -> Column:
        number = F.regexp_replace(piece, r"[,\sk]", "").try_cast("double")
        return F.when(piece.endswith("k"), number * 1000).otherwise(number)

    found = F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit(MAX_PATTERN), F.lit(0)
    )
    best = F.array_max(F.filter(F.transform(found, amount), lambda x: x > 0))
    return F.coalesce(best, F.lit(0.0))


# Salary steps of the search form and their codes.
SALARY_STEPS = [
    (40000, "1"), (60000, "2"), (80000, "3"), (100000, "4"), (120000, "5"),
    (140000, "6"), (160000, "7"), (180000, "8"), (200000, "9"),
]


def salary_bucket(amount: Column) -> Column:
    """Code of the lowest step that holds the amount, the last one above all; null unless positive."""
    out = None
    for top, code in SALARY_STEPS:
        out = F.when(amount <= top, code) if out is None else out.when(amount <= top, code)
    return F.when(amount > 0, out.otherwise(SALARY_STEPS[-1][1]))
