"""Revenue over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.filters import SalesFilter
from tillscope.functions.calendar import (
    day_month_label,
    month_name,
    month_start,
    month_year_label,
    quarter_label,
)
from tillscope.functions.money import money_or_zero, per_unit, share_pct
from tillscope.model import Star
from tillscope.operators.facts import LINES, REVENUE, ROWS, aggregate, by_product, grand_total, rows

# Ranges longer than this many days are shown by month.
DAILY_LIMIT = 70


def by_year() -> dict[str, Column]:
    return {"yr": F.year("sale_date")}


def by_quarter() -> dict[str, Column]:
    return {"quarter_no": F.quarter("sale_date")}


def by_month() -> dict[str, Column]:
    return {"month_no": F.month("sale_date")}


def revenue_by_year(star: Star) -> DataFrame:
    return aggregate(star.summed, [REVENUE], by_year()).orderBy(F.asc_nulls_last("yr"))


def revenue_by_quarter(star: Star) -> DataFrame:
    """Quarter numbers 1..4; the same quarter of different years is one row."""
    totals = aggregate(star.summed, [REVENUE], by_quarter())
    return totals.select(
        "quarter_no", quarter_label(F.col("quarter_no")).alias("period"), "revenue"
    ).orderBy(F.asc_nulls_last("quarter_no"))


def revenue_by_month(star: Star) -> DataFrame:
    """Month numbers 1..12; the same month of different years is one row."""
    totals = aggregate(star.summed, [REVENUE], by_month())
    return totals.select(
        month_name(F.col("month_no")).alias("month"), "month_no", "revenue"
    ).orderBy(F.asc_nulls_last("month_no"))


def revenue_by_year_quarter(star: Star) -> DataFrame:
    totals = aggregate(star.summed, [REVENUE], {**by_year(), **by_quarter()})
    return totals.select(
        "yr", quarter_label(F.col("quarter_no")).alias("quarter"), "revenue"
    ).orderBy(F.asc_nulls_last("yr"), F.asc_nulls_last("quarter"))


def revenue_trend(star: Star, flt: SalesFilter) -> DataFrame:
    """Revenue and order lines per month for long ranges, per day for short ones."""
    monthly = flt.days > DAILY_LIMIT
    bucket = month_start(F.col("sale_date")) if monthly else F.col("sale_date")
    label = month_year_label if monthly else day_month_label
    totals = by_product(star, [REVENUE, LINES.named("orders")], flt, {"period_date": bucket})
    return totals.select(
        "period_date", label(F.col("period_date")).alias("period_label"), "revenue", "orders"
    ).orderBy(F.asc_nulls_last("period_date"))


def _periods(star: Star, level: str) -> DataFrame:
    """Columns period_no, period, revenue for one of the levels year, quarter, month."""
    if level == "year":
        totals = aggregate(star.summed, [REVENUE], by_year()).withColumnRenamed("yr", "period_no")
        period = F.col("period_no").cast("string")
    elif level == "quarter":
        totals = aggregate(star.summed, [REVENUE], by_quarter()).withColumnRenamed("quarter_no", "period_no")
        period = quarter_label(F.col("period_no"))
    elif level == "month":
        totals = aggregate(star.summed, [REVENUE], by_month()).withColumnRenamed("month_no", "period_no")
        period = month_name(F.col("period_no"))
    else:
        raise ValueError(f"unknown period level {level!r}")
    return totals.select("period_no", period.alias("period"), "revenue")


def period_summary(star: Star, level: str = "month") -> DataFrame:
    """One row: total, number of periods with sales, mean per such period and the peak period.

    The peak is the greatest (revenue, -number) pair, so the earliest period wins a tie.
    """
    rank = F.struct("revenue", -F.col("period_no"), "period")
    summary = _periods(star, level).agg(
        money_or_zero(F.sum("revenue")).alias("total_revenue"),
        rows().alias("period_count"),
        F.max(rank).alias("peak"),
    )
    return summary.select(
        "total_revenue",
        "period_count",
        per_unit(F.col("total_revenue"), F.col("period_count")).alias("avg_revenue"),
        F.col("peak.period").alias("peak_period"),
        F.col("peak.revenue").alias("peak_revenue"),
    )


def period_share(star: Star, level: str = "month") -> DataFrame:
    """Each period's revenue and its share of the total, in calendar order."""
    periods = _periods(star, level)
    total = grand_total(periods, "revenue").getField("revenue")
    return periods.select(
        "period_no", "period", "revenue", share_pct(F.col("revenue"), total).alias("share_pct")
    ).orderBy(F.asc_nulls_last("period_no"))


def date_coverage(star: Star) -> DataFrame:
    """One row: first date, last date and how many different calendar months have sales."""
    per_month = star.summed.groupBy(F.month("sale_date").alias("month_no")).agg(
        F.min("sale_date").alias("first"), F.max("sale_date").alias("last")
    )
    return per_month.agg(
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
        F.count("month_no").alias("distinct_months"),
    )


def monthly_activity(star: Star) -> DataFrame:
    """Sales lines and revenue per calendar month."""
    fact = star.summed
    per_month = fact.groupBy(F.month("sale_date").alias("month_no")).agg(
        ROWS.named("tx_count").first_step(fact), REVENUE.first_step(fact)
    )
    return per_month.select(
        "month_no", month_name(F.col("month_no")).alias("month_name"), "tx_count", "revenue"
    ).orderBy(F.asc_nulls_last("month_no"))
