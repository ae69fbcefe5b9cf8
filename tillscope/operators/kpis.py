"""Headline numbers, period comparison and the values that fill the filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.filters import ALL, SalesFilter
from tillscope.functions.calendar import month_name
from tillscope.functions.money import (
    change_direction,
    change_label,
    change_pct,
    exact_mean,
    money_or_zero,
    money_sum,
    per_unit,
)
from tillscope.model import SALE_YEAR, Star
from tillscope.operators.facts import AMOUNTS, REVENUE, ROWS, aggregate, rows, sold_lines


def total_kpis(star: Star) -> DataFrame:
    """One row: revenue and number of sales, products and customers, all unfiltered."""
    facts = aggregate(star.summed, [REVENUE.named("total_revenue"), ROWS.named("total_orders")], {})
    return facts.select(
        "total_revenue",
        "total_orders",
        star.products.agg(rows()).scalar().alias("total_products"),
        star.customers.agg(rows()).scalar().alias("total_customers"),
    )


def _period_measures() -> list[Column]:
    return [
        money_sum(F.col("total_amount")).alias("revenue"),
        F.count_distinct("sale_id").alias("orders"),
        F.count_distinct("customer_id").alias("active_customers"),
    ]


def period_kpis(star: Star, flt: SalesFilter) -> DataFrame:
    """One row: revenue, distinct orders, distinct customers and average order value of a period."""
    lines = sold_lines(star, flt, "sale_id", "customer_id", "total_amount")
    return (
        lines.agg(*_period_measures())
        .withColumn("revenue", money_or_zero(F.col("revenue")))
        .withColumn("aov", per_unit(F.col("revenue"), F.col("orders")))
    )


COMPARED = ("revenue", "orders", "customers", "aov")


def period_pair(star: Star, flt: SalesFilter) -> DataFrame:
    """One row: the measures of a period (cur_*) and of the period of the same length before (prior_*).

    The two ranges are disjoint and adjacent, so one pass over both tags each line; the tagged totals
    (two rows) are then turned into columns by a global aggregate, which always yields a row.
    """
    both = SalesFilter(flt.prior().start, flt.end, flt.category)
    tagged = (
        sold_lines(star, both, "sale_date", "sale_id", "customer_id", "total_amount")
        .groupBy((F.col("sale_date") >= F.lit(flt.start)).alias("is_current"))
        .agg(*_period_measures())
    )

    def side(prefix: str, chosen: Column) -> list[Column]:
        def pick(name: str) -> Column:
            return F.max(F.when(chosen, F.col(name)))

        return [
            money_or_zero(pick("revenue")).alias(f"{prefix}_revenue"),
            F.coalesce(pick("orders"), F.lit(0)).alias(f"{prefix}_orders"),
            F.coalesce(pick("active_customers"), F.lit(0)).alias(f"{prefix}_customers"),
        ]

    current = F.col("is_current")
    wide = tagged.agg(*side("cur", current), *side("prior", ~current))
    return wide.select(
        "*",
        *[
            per_unit(F.col(f"{p}_revenue"), F.col(f"{p}_orders")).alias(f"{p}_aov")
            for p in ("cur", "prior")
        ],
    )


def period_comparison(star: Star, flt: SalesFilter) -> DataFrame:
    """One row: a period against the one before, with change, direction and label per measure."""
    pair = period_pair(star, flt)
    changes = [
        change_pct(F.col(f"cur_{n}"), F.col(f"prior_{n}")).alias(f"{n}_pct") for n in COMPARED
    ]
    return pair.select("*", *changes).select(
        "*",
        *[change_direction(F.col(f"{n}_pct")).alias(f"{n}_direction") for n in COMPARED],
        *[change_label(F.col(f"{n}_pct")).alias(f"{n}_label") for n in COMPARED],
    )


def filter_bounds(star: Star) -> DataFrame:
    """One row: first and last sale date, today for both when there are no sales.

    Of sales stored by year only the partitions of the first and the last year are read.
    """
    sales = star.summed
    if SALE_YEAR in sales.columns:
        year = F.col(SALE_YEAR)
        first, last = (star.summed.agg(end(SALE_YEAR)).scalar() for end in (F.min, F.max))
        sales = sales.where((year == first) | (year == last))
    return sales.agg(
        F.coalesce(F.min("sale_date"), F.current_date()).alias("min_date"),
        F.coalesce(F.max("sale_date"), F.current_date()).alias("max_date"),
    )


def _sale_year(star: Star) -> Column:
    """The year of a sale; of sales stored by year it takes no column of the files."""
    return F.col(SALE_YEAR).cast("int") if SALE_YEAR in star.summed.columns else F.year("sale_date")


def sale_years(star: Star) -> DataFrame:
    return star.summed.select(_sale_year(star).alias("yr")).distinct().orderBy(F.desc_nulls_first("yr"))


def categories(star: Star) -> DataFrame:
    return star.products.select("category").distinct().orderBy(F.asc_nulls_last("category"))


def sale_months(star: Star) -> DataFrame:
    """Month numbers and names that occur in the sales of any year."""
    numbers = star.summed.select(F.month("sale_date").alias("month_no")).distinct()
    return numbers.select(month_name(F.col("month_no")).alias("month"), "month_no").orderBy("month_no")


def year_ranges(star: Star) -> DataFrame:
    """One row per year with sales: the year clamped to the first and last sale date, newest first.

    Only the first year's start and the last year's end can be clamped, and there the bound is that
    year's own extreme date. Outer query and subquery so need the same per-year extremes, and Spark
    computes them once. Of sales stored by year, the years and bounds come from the partitions.
    """
    if SALE_YEAR in star.summed.columns:
        bounds = filter_bounds(star).select(F.struct("min_date", "max_date").alias("bounds")).scalar()
        years = star.summed.select(_sale_year(star).alias("yr")).where("yr IS NOT NULL").distinct()
        return (
            years.withColumn("bounds", bounds)
            .select(
                "yr",
                F.greatest(F.make_date("yr", F.lit(1), F.lit(1)), "bounds.min_date").alias("start_date"),
                F.least(F.make_date("yr", F.lit(12), F.lit(31)), "bounds.max_date").alias("end_date"),
            )
            .orderBy(F.desc("yr"))
        )
    dated = star.summed.where(F.col("sale_date").isNotNull())
    per_year = dated.groupBy(F.year("sale_date").alias("yr")).agg(
        F.min("sale_date").alias("first"), F.max("sale_date").alias("last")
    )
    span = per_year.agg(
        F.struct(F.min("first").alias("first"), F.max("last").alias("last")).alias("span")
    ).scalar()
    is_first = F.col("first") == F.col("span.first")
    is_last = F.col("last") == F.col("span.last")
    return (
        per_year.withColumn("span", span)
        .select(
            "yr",
            F.when(is_first, F.col("first"))
            .otherwise(F.make_date("yr", F.lit(1), F.lit(1)))
            .alias("start_date"),
            F.when(is_last, F.col("last"))
            .otherwise(F.make_date("yr", F.lit(12), F.lit(31)))
            .alias("end_date"),
        )
        .orderBy(F.desc("yr"))
    )


def filter_for_year(star: Star, year: int | str | None = None, category: str = ALL) -> SalesFilter:
    """Filter for a year (default: the latest) or for "All Years". Fetches one row of bounds."""
    low, high = filter_bounds(star).first()
    if year == "All Years":
        return SalesFilter(low, high, category)
    chosen = high.year if year is None else int(year)
    return SalesFilter(max(date(chosen, 1, 1), low), min(date(chosen, 12, 31), high), category)


def average_sale(star: Star) -> DataFrame:
    """One row: mean amount per sales line, two places."""
    totals = aggregate(star.summed, [REVENUE, AMOUNTS], {})
    return totals.select(exact_mean(F.col("revenue"), F.col("amounts")).alias("avg_order"))
