"""Every registered query by name, with the arguments it runs with.

Results leave through one edge rule: decimals become double, integers bigint and dates ISO text, so
that two engines can be compared value by value, whatever client reads them. The operators themselves
return decimals and dates.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.filters import InventoryFilter, SalesFilter, StockBand
from tillscope.model import Star
from tillscope.operators import (
    customers,
    insights,
    inventory,
    kpis,
    olap,
    products,
    quality,
    trends,
    views,
)
from tillscope.sources.colocated import colocated
from tillscope.sources.daily import with_daily
from tillscope.sources.order_tables import load_order_tables
from tillscope.sources.refresh import gated_write

CATEGORY = "SMALL"
MONTH = "March"
YEAR_1997 = SalesFilter(date(1997, 1, 1), date(1997, 12, 31))
YEAR_1997_CATEGORY = SalesFilter(YEAR_1997.start, YEAR_1997.end, CATEGORY)
MARCH_1998 = SalesFilter(date(1998, 3, 1), date(1998, 3, 31))
FIRST_YEAR = SalesFilter(date(1995, 1, 1), date(1995, 12, 31))
IN_CATEGORY = InventoryFilter(category=CATEGORY)
SEARCH = InventoryFilter(search=" Gear|^Red ", band=StockBand.ATTENTION)
GEARS = InventoryFilter(search="gear", literal=True)
HIGH_TARGET = 100
EMPTY_YEAR = SalesFilter(date(1980, 1, 1), date(1980, 12, 31))
DAYS_70 = SalesFilter(date(1998, 1, 1), date(1998, 3, 11))
DAYS_71 = SalesFilter(date(1998, 1, 1), date(1998, 3, 12))


def counts_as_double(df: DataFrame) -> DataFrame:
    """Integer columns that may be null as double, since some clients have no integer null."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.LongType) else f.name
            for f in df.schema
        ]
    )


QUERIES: dict[str, Callable[[Star], DataFrame]] = {
    # headline numbers and filter values
    "total_kpis": kpis.total_kpis,
    "filter_bounds": kpis.filter_bounds,
    "sale_years": kpis.sale_years,
    "categories": kpis.categories,
    "sale_months": kpis.sale_months,
    "year_range": kpis.year_ranges,
    "period_kpis_all": lambda s: kpis.period_kpis(s, YEAR_1997),
    "period_kpis_category": lambda s: kpis.period_kpis(s, YEAR_1997_CATEGORY),
    "period_comparison": lambda s: kpis.period_comparison(s, YEAR_1997),
    "period_comparison_category": lambda s: kpis.period_comparison(s, YEAR_1997_CATEGORY),
    "period_comparison_no_prior": lambda s: kpis.period_comparison(s, FIRST_YEAR),
    "period_kpis_empty": lambda s: kpis.period_kpis(s, EMPTY_YEAR),
    "average_sale": kpis.average_sale,
    # time
    "trend_monthly": lambda s: trends.revenue_trend(s, YEAR_1997),
    "trend_monthly_category": lambda s: trends.revenue_trend(s, YEAR_1997_CATEGORY),
    "trend_daily": lambda s: trends.revenue_trend(s, MARCH_1998),
    "trend_70_days": lambda s: trends.revenue_trend(s, DAYS_70),
    "trend_71_days": lambda s: trends.revenue_trend(s, DAYS_71),
    "revenue_by_year": trends.revenue_by_year,
    "revenue_by_quarter": trends.revenue_by_quarter,
    "revenue_by_month": trends.revenue_by_month,
    "revenue_by_year_quarter": trends.revenue_by_year_quarter,
    "period_summary": trends.period_summary,
    "period_summary_year": lambda s: trends.period_summary(s, "year"),
    "period_share": trends.period_share,
    "period_share_quarter": lambda s: trends.period_share(s, "quarter"),
    "date_coverage": trends.date_coverage,
    "monthly_activity": trends.monthly_activity,
    # categories and products
    "category_revenue": products.category_revenue,
    "category_revenue_one": lambda s: products.category_revenue(s, CATEGORY),
    "category_breakdown": lambda s: products.category_breakdown(s, YEAR_1997),
    "category_coverage": products.category_coverage,
    "product_performance": products.product_performance,
    "product_performance_category": lambda s: products.product_performance(s, CATEGORY),
    "units_by_product": products.units_by_product,
    "top_products_units": products.top_products_by_units,
    "top_products_units_category": lambda s: products.top_products_by_units(s, CATEGORY),
    "top_products_revenue": lambda s: products.top_products_by_revenue(s, YEAR_1997),
    "best_product": products.best_product,
    "best_category": products.best_category,
    # customers
    "customer_kpis": customers.customer_kpis,
    "average_rating": customers.average_rating,
    "active_customer_rating": lambda s: customers.active_customer_rating(s, YEAR_1997_CATEGORY),
    "rating_distribution": customers.rating_distribution,
    "top_customers": customers.top_customers,
    "top_customers_period": lambda s: customers.top_customers_in_period(s, YEAR_1997),
    "customer_summary": customers.customer_summary,
    "recent_sales": customers.recent_sales,
    # inventory
    "inventory_status": inventory.inventory_status,
    "inventory_bands": inventory.inventory_bands,
    "low_stock_count": inventory.low_stock_count,
    "low_stock": inventory.low_stock,
    "urgent_stock": inventory.urgent_stock,
    "stock_by_category": inventory.stock_by_category,
    "inventory_by_category": lambda s: inventory.inventory_by_category(s, GEARS),
    "inventory_catalog": inventory.inventory_catalog,
    "inventory_search": lambda s: inventory.inventory_catalog(s, SEARCH),
    "inventory_out": lambda s: inventory.inventory_catalog(s, InventoryFilter(band=StockBand.OUT)),
    "inventory_low": lambda s: inventory.inventory_catalog(s, InventoryFilter(band=StockBand.LOW)),
    "inventory_in": lambda s: inventory.inventory_catalog(s, InventoryFilter(band=StockBand.IN)),
    "inventory_kpis": lambda s: inventory.inventory_kpis(s, IN_CATEGORY),
    "stock_distribution": lambda s: inventory.stock_distribution(s, IN_CATEGORY),
    "stock_distribution_low": lambda s: inventory.stock_distribution(s, InventoryFilter(band=StockBand.LOW)),
    "restock_plan": inventory.restock_plan,
    "restock_plan_target": lambda s: inventory.restock_plan(s, IN_CATEGORY, HIGH_TARGET),
    "restock_totals": inventory.restock_totals,
    # OLAP
    "olap_rollup": olap.rollup_years,
    "olap_drilldown": olap.drilldown_months,
    "olap_calendar_rollup": olap.calendar_rollup,
    "olap_slice_all": olap.slice_all,
    "olap_slice_category": lambda s: olap.slice_category(s, CATEGORY),
    "olap_dice": lambda s: olap.dice(s, CATEGORY, MONTH),
    "olap_dice_all": olap.dice,
    "olap_dice_month": lambda s: olap.dice(s, month=MONTH),
    "olap_dice_category": lambda s: olap.dice(s, CATEGORY),
    "olap_pivot": olap.pivot,
    # insights
    "executive_insights": lambda s: counts_as_double(insights.executive_insights(s, YEAR_1997)),
    "executive_insight_texts": lambda s: insights.insight_texts(
        insights.executive_insights(s, YEAR_1997)
    ),
    "executive_insights_no_prior": lambda s: counts_as_double(insights.executive_insights(s, FIRST_YEAR)),
    "executive_insight_texts_no_prior": lambda s: insights.insight_texts(
        insights.executive_insights(s, FIRST_YEAR)
    ),
    "olap_insights": insights.olap_insights,
    # data quality
    "row_counts": quality.row_counts,
    "quality_report": quality.quality_report,
    "gated_write": gated_write,
    "colocated_product_performance": lambda s: products.product_performance(colocated(s)),
    "colocated_customer_summary": lambda s: customers.customer_summary(colocated(s)),
    "daily_total_kpis": lambda s: kpis.total_kpis(with_daily(s)),
    "daily_trend_monthly_category": lambda s: trends.revenue_trend(with_daily(s), YEAR_1997_CATEGORY),
    "daily_category_breakdown": lambda s: products.category_breakdown(with_daily(s), YEAR_1997),
    "daily_olap_calendar_rollup": lambda s: olap.calendar_rollup(with_daily(s)),
    "daily_olap_dice": lambda s: olap.dice(with_daily(s), CATEGORY, MONTH),
    # report views and exports
    "category_view": lambda s: views.category_view(s, YEAR_1997),
    "top_products_view": lambda s: views.top_products_view(s, YEAR_1997),
    "top_customers_view": lambda s: views.top_customers_view(s, YEAR_1997),
    "urgent_stock_view": views.urgent_stock_view,
    "period_view": views.period_view,
    "restock_view": views.restock_view,
    "catalog_view": views.catalog_view,
    "inventory_report": views.inventory_report,
    "sales_report": views.sales_report,
}


def at_edge(df: DataFrame) -> DataFrame:
    """Decimals as double, integers as bigint, dates as text, everything else as it is."""
    columns = []
    for field in df.schema:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DecimalType):
            name = f"CAST({name} AS DOUBLE) AS {name}"
        elif isinstance(field.dataType, T.IntegralType):
            name = f"CAST({name} AS BIGINT) AS {name}"
        elif isinstance(field.dataType, T.DateType):
            name = f"CAST({name} AS STRING) AS {name}"
        columns.append(name)
    return df.selectExpr(*columns)


def on_order_tables(
    query: Callable[[Star], DataFrame],
) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of a session and a folder of order-processing tables.

    Each call opens the tables anew, so that it sees files that were added since the last.
    """
    return lambda spark, path: at_edge(query(load_order_tables(spark, path)))
