"""Category and product revenue, units and rankings over sales of known products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.filters import ALL, SalesFilter
from tillscope.functions.money import share_pct
from tillscope.model import Star
from tillscope.operators.facts import LINES, REVENUE, UNITS, Measure, by_product, grand_total


def category_revenue(star: Star, category: str = ALL) -> DataFrame:
    totals = by_product(star, [REVENUE], SalesFilter(category=category), product_keys=["category"])
    return totals.orderBy(F.desc("revenue"), F.asc_nulls_last("category"))


def category_breakdown(
    star: Star, flt: SalesFilter, measures: Sequence[Measure] = (REVENUE, UNITS, LINES)
) -> DataFrame:
    """Measures (revenue among them) and revenue share per category in a period.

    Ask for no more measures than are used: dropping one later would leave the outer query and the
    total's subquery with different aggregations, which Spark could not share.
    """
    totals = by_product(star, measures, flt, product_keys=["category"])
    total = grand_total(totals, *[m.name for m in measures]).getField("revenue")
    return totals.withColumn("share_pct", share_pct(F.col("revenue"), total)).orderBy(
        F.desc("revenue"), F.asc_nulls_last("category")
    )


def category_coverage(star: Star) -> DataFrame:
    """Order lines, units and revenue per category over all sales."""
    measures = [LINES.named("sales_count"), UNITS, REVENUE]
    return by_product(star, measures, product_keys=["category"]).orderBy(
        F.desc("revenue"), F.asc_nulls_last("category")
    )


def product_performance(star: Star, category: str = ALL) -> DataFrame:
    """Units and revenue per (name, category); products that share both are one row."""
    return by_product(
        star,
        [UNITS, REVENUE],
        SalesFilter(category=category),
        product_keys=["product_name", "category"],
    ).orderBy(F.desc("revenue"), F.asc_nulls_last("product_name"), F.asc_nulls_last("category"))


def units_by_product(star: Star, category: str = ALL) -> DataFrame:
    """Units per product name; products that share a name are one row."""
    return by_product(
        star, [UNITS], SalesFilter(category=category), product_keys=["product_name"]
    )


def top_products_by_units(star: Star, category: str = ALL, n: int = 10) -> DataFrame:
    ranked = units_by_product(star, category)
    return ranked.orderBy(F.desc("units_sold"), F.asc_nulls_last("product_name")).limit(n)


def top_products_by_revenue(star: Star, flt: SalesFilter, n: int = 5) -> DataFrame:
    totals = by_product(star, [REVENUE, UNITS], flt, product_keys=["product_name", "category"])
    return totals.orderBy(
        F.desc("revenue"), F.asc_nulls_last("product_name"), F.asc_nulls_last("category")
    ).limit(n)


def best_product(star: Star) -> DataFrame:
    """The product name with the most units."""
    return top_products_by_units(star, n=1)


def best_category(star: Star) -> DataFrame:
    """The category with the most revenue."""
    return category_revenue(star).limit(1)
