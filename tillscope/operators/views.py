"""Report views: picked, renamed and formatted columns, ready to print or export.

The column titles are fixed values: readers of the reports go by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.filters import InventoryFilter, SalesFilter
from tillscope.functions.money import count_text, currency_text, percent_text
from tillscope.functions.stock import TARGET_DEFAULT
from tillscope.model import Star
from tillscope.operators.customers import top_customers_in_period
from tillscope.operators.facts import REVENUE
from tillscope.operators.inventory import (
    EVERYTHING,
    inventory_catalog,
    restock_plan,
    urgent_stock,
)
from tillscope.operators.products import category_breakdown, top_products_by_revenue
from tillscope.operators.trends import period_share


def _view(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    return df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(title) for title, c in columns.items()]
    )


def rating_text(rate: Column) -> Column:
    """One decimal place of the binary value, like every other label."""
    return F.concat(F.lit("⭐ "), F.call_function("format_number", rate.cast("double"), F.lit("0.0")))


def mean_rating_text(rate: Column) -> Column:
    """Out of five, or N/A for the 0 that stands for no rating."""
    shown = F.concat(F.call_function("format_number", rate, F.lit("0.00")), F.lit(" / 5.0"))
    return F.when(rate > 0, shown).otherwise("N/A")


def category_view(star: Star, flt: SalesFilter) -> DataFrame:
    return _view(
        category_breakdown(star, flt, [REVENUE]),
        {
            "Category": "category",
            "Revenue": currency_text(F.col("revenue")),
            "% of Total": percent_text(F.col("share_pct")),
        },
    )


def top_products_view(star: Star, flt: SalesFilter, n: int = 5) -> DataFrame:
    return _view(
        top_products_by_revenue(star, flt, n),
        {
            "Product": "product_name",
            "Category": "category",
            "Revenue": currency_text(F.col("revenue")),
            "Units Sold": count_text(F.col("units_sold")),
        },
    )


def top_customers_view(star: Star, flt: SalesFilter, n: int = 5) -> DataFrame:
    return _view(
        top_customers_in_period(star, flt, n),
        {
            "Customer Name": "customer_name",
            "Total Spent": currency_text(F.col("total_spent")),
            "Orders": "orders",
            "Rating": rating_text(F.col("rating")),
        },
    )


def urgent_stock_view(star: Star, n: int = 6) -> DataFrame:
    return _view(
        urgent_stock(star, n),
        {
            "Product": "product_name",
            "Category": "category",
            "Stock Left": "stock",
            "Status": "status",
        },
    )


def period_view(star: Star, level: str = "month") -> DataFrame:
    return _view(
        period_share(star, level),
        {
            level.capitalize(): "period",
            "Revenue (₹)": currency_text(F.col("revenue"), 2),
            "% of Total Revenue": percent_text(F.col("share_pct")),
        },
    )


def restock_view(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    return _view(
        restock_plan(star, flt, target),
        {
            "Priority Urgency": "urgency",
            "Product Name": "product_name",
            "Category": "category",
            "Current Stock": "stock",
            "Target Stock": "target_stock",
            "Suggested Reorder Qty": "suggested_reorder",
            "Unit Price": currency_text(F.col("price"), 2),
            "Est. Restock Cost": currency_text(F.col("est_reorder_cost"), 2),
        },
    )


def catalog_view(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    return _view(
        inventory_catalog(star, flt, target),
        {
            "Product ID": "product_id",
            "Product Name": "product_name",
            "Category": "category",
            "Unit Price (₹)": currency_text(F.col("price"), 2),
            "Current Stock": "stock",
            "Status": "status_label",
            "Target Level": "target_stock",
            "Suggested Reorder": "suggested_reorder",
            "Est. Restock Cost (₹)": currency_text(F.col("est_reorder_cost"), 2),
        },
    )


def inventory_report(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    """The inventory export: raw numbers under report titles, by category and name."""
    return _view(
        inventory_catalog(star, flt, target),
        {
            "Product ID": "product_id",
            "Product Name": "product_name",
            "Category": "category",
            "Unit Price (INR)": "price",
            "Current Stock": "stock",
            "Stock Status": "stock_status",
            "Target Stock Level": "target_stock",
            "Suggested Reorder Qty": "suggested_reorder",
            "Estimated Restock Cost (INR)": "est_reorder_cost",
        },
    )


def sales_report(star: Star, n: int = 10) -> DataFrame:
    """The newest sales lines with all their columns."""
    keys = ["sale_id", "product_id", "customer_id", "quantity", "total_amount"]
    return (
        star.sales.select("sale_id", "sale_date", "customer_id", "product_id", "quantity", "total_amount")
        .orderBy(F.desc_nulls_first("sale_date"), *[F.asc_nulls_last(k) for k in keys])
        .limit(n)
    )
