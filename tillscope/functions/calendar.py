"""Calendar buckets and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they appear in filters and results.
MONTHS = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)


def month_number(name: str) -> int | None:
    """1..12 for a month name, None for anything else."""
    return MONTHS.index(name) + 1 if name in MONTHS else None


def month_name(number: Column) -> Column:
    """Full month name of a month number. Meant for after the aggregation, on at most 12 rows."""
    return F.date_format(F.make_date(F.lit(2000), number, F.lit(1)), "MMMM")


def quarter_label(number: Column) -> Column:
    return F.concat(F.lit("Q"), number.cast("string"))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_year_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def day_month_label(day: Column) -> Column:
    return F.date_format(day, "dd MMM")
