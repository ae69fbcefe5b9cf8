"""Roll-up, drill-down, slice, dice and pivot over revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.filters import ALL, SalesFilter, month_predicate
from tillscope.functions.calendar import MONTHS, month_name, quarter_label
from tillscope.model import Star
from tillscope.operators.facts import LINES, REVENUE, by_product
from tillscope.operators.trends import by_month, by_quarter, by_year, revenue_by_month, revenue_by_year


def rollup_years(star: Star) -> DataFrame:
    return revenue_by_year(star)


def drilldown_months(star: Star) -> DataFrame:
    return revenue_by_month(star)


def calendar_rollup(star: Star) -> DataFrame:
    """Revenue and order lines of all sales, of each year, of its quarters and of its months, from one scan.

    Lines are folded to months first; the levels above are grouping sets over those few rows. Lines without a date are
    the period "unknown" at each level. No sales give no rows.
    """
    measures = [REVENUE, LINES]
    keys = {**by_year(), **by_quarter(), **by_month()}
    fact = star.summed
    months = fact.groupBy(*[expr.alias(name) for name, expr in keys.items()]).agg(*[m.first_step(fact) for m in measures])
    levels = months.rollup(*keys).agg(F.grouping_id().alias("depth"), *[m.next_step() for m in measures])
    year, depth = F.col("yr").cast("string"), F.col("depth")
    period = (
        F.when(depth == 7, F.lit("all"))
        .when(depth == 3, year)
        .when(depth == 1, F.concat_ws(" ", year, quarter_label(F.col("quarter_no"))))
        .otherwise(F.concat_ws("-", year, F.lpad(F.col("month_no").cast("string"), 2, "0")))
    )
    level = F.when(depth == 7, "total").when(depth == 3, "year").when(depth == 1, "quarter").otherwise("month")
    named = F.when((depth < 7) & F.col("yr").isNull(), F.lit("unknown")).otherwise(period)
    return levels.orderBy(F.desc("depth"), *[F.asc_nulls_last(k) for k in keys]).select(
        level.alias("level"), named.alias("period"), *[m.result() for m in measures]
    )


def slice_all(star: Star) -> DataFrame:
    """Revenue per category."""
    return by_product(star, [REVENUE], product_keys=["category"])


def slice_category(star: Star, category: str) -> DataFrame:
    """Revenue per product name inside one category."""
    return by_product(
        star, [REVENUE], SalesFilter(category=category), product_keys=["product_name"]
    )


def dice(star: Star, category: str = ALL, month: str = ALL) -> DataFrame:
    """Revenue per category and calendar month, under any combination of the two filters."""
    totals = by_product(star, [REVENUE], SalesFilter(category=category), by_month(), ["category"], month_predicate(month))
    return totals.orderBy("month_no", F.asc_nulls_last("category")).select(
        "category", month_name(F.col("month_no")).alias("month"), "revenue"
    )


def pivot(star: Star) -> DataFrame:
    """Categories as rows, the twelve months as columns, 0 where nothing was sold.

    The fact is aggregated to one row per category and month first; only those rows are pivoted.
    Naming the months fixes the schema and saves the job that would look for them.
    """
    cells = by_product(star, [REVENUE], fact_keys=by_month(), product_keys=["category"])
    wide = (
        cells.where(F.col("category").isNotNull())
        .groupBy("category")
        .pivot("month_no", list(range(1, 13)))
        .agg(F.sum("revenue"))
    )
    months = [
        F.coalesce(F.col(str(number)), F.lit(0)).alias(name)
        for number, name in enumerate(MONTHS, start=1)
    ]
    return wide.select("category", *months).orderBy("category")
