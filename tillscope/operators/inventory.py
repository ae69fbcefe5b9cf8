"""Stock classification, replenishment planning and inventory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.filters import InventoryFilter, StockBand
from tillscope.functions.stock import (
    IN_STOCK,
    LOW_STOCK,
    LOW_STOCK_LIMIT,
    OUT_OF_STOCK,
    TARGET_DEFAULT,
    alert_label,
    catalog_label,
    check_target,
    severity,
    stock_status,
    suggested_reorder,
    unit_price,
    urgency_badge,
    whole_units,
)
from tillscope.model import Star
from tillscope.operators.facts import rows

EVERYTHING = InventoryFilter()


def _zero_if_none(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def inventory(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    """Filtered products with status, severity and replenishment columns; the base of this module.

    Missing or unreadable price and stock count as 0. The filter runs on the raw columns, so that it
    reaches the scan.
    """
    products = flt.apply(star.products)
    stock = F.coalesce(whole_units(products, "stock"), F.lit(0))
    price = F.coalesce(unit_price(products, "price"), F.lit(0))
    cleaned = products.select(
        "product_id", "product_name", "category", price.alias("price"), stock.alias("stock")
    )
    units = F.col("stock")
    return cleaned.select(
        "*",
        stock_status(units).alias("stock_status"),
        severity(units).alias("severity"),
        F.lit(check_target(target)).alias("target_stock"),
        suggested_reorder(units, target).alias("suggested_reorder"),
    ).withColumn("est_reorder_cost", F.col("suggested_reorder") * F.col("price"))


def inventory_status(star: Star) -> DataFrame:
    """Products per status, most frequent first. Null stock counts as in stock here."""
    return (
        star.products.groupBy(stock_status(F.col("stock")).alias("status"))
        .agg(rows().alias("total"))
        .orderBy(F.desc("total"), "status")
    )


def inventory_bands(star: Star) -> DataFrame:
    """One row of band counts; negative and null stock is in no band but in the total."""
    stock = F.col("stock")
    return star.products.agg(
        F.count_if(stock == 0).alias("out_of_stock"),
        F.count_if((stock > 0) & (stock <= LOW_STOCK_LIMIT)).alias("low_stock"),
        F.count_if(stock > LOW_STOCK_LIMIT).alias("in_stock"),
        rows().alias("total_products"),
    )


def low_stock_count(star: Star) -> DataFrame:
    """One row: products at or under the low-stock limit, sold-out ones included."""
    return star.products.where(F.col("stock") <= LOW_STOCK_LIMIT).agg(rows().alias("low_stock"))


def low_stock(star: Star) -> DataFrame:
    """All products at or under the low-stock limit, scarcest first."""
    return (
        star.products.where(F.col("stock") <= LOW_STOCK_LIMIT)
        .select("product_id", "product_name", "category", "stock")
        .orderBy("stock", F.asc_nulls_last("product_name"), F.asc_nulls_last("product_id"))
    )


def urgent_stock(star: Star, n: int = 6) -> DataFrame:
    """The scarcest products with their alert text."""
    scarce = star.products.where(F.col("stock") <= LOW_STOCK_LIMIT)
    return (
        scarce.select("product_name", "category", "stock")
        .orderBy("stock", F.asc_nulls_last("product_name"), F.asc_nulls_last("category"))
        .limit(n)
        .withColumn("status", alert_label(F.col("stock")))
    )


def stock_by_category(star: Star) -> DataFrame:
    return (
        star.products.groupBy("category")
        .agg(_zero_if_none(F.sum("stock")).alias("stock"))
        .orderBy(F.asc_nulls_last("category"))
    )


def inventory_by_category(star: Star, flt: InventoryFilter = EVERYTHING) -> DataFrame:
    """Units and products per category of the filtered inventory."""
    return (
        inventory(star, flt)
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("stock").alias("total_stock"), F.count("product_id").alias("sku_count"))
        .orderBy(F.desc("total_stock"), "category")
    )


def inventory_kpis(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    """One row over the filtered inventory. Products without a category count as one category."""
    stock, reorder = F.col("stock"), F.col("suggested_reorder")
    uncategorised = F.max(F.when(F.col("category").isNull(), 1).otherwise(0))
    return inventory(star, flt, target).agg(
        rows().alias("skus"),
        (F.count_distinct("category") + _zero_if_none(uncategorised)).alias("categories"),
        F.count_if(stock > LOW_STOCK_LIMIT).alias("in_stock"),
        F.count_if((stock > 0) & (stock <= LOW_STOCK_LIMIT)).alias("low_stock"),
        F.count_if(stock == 0).alias("out_of_stock"),
        _zero_if_none(F.sum("stock")).alias("units_on_hand"),
        _zero_if_none(F.sum(F.when(stock <= LOW_STOCK_LIMIT, reorder))).alias("reorder_units"),
    )


def stock_distribution(star: Star, flt: InventoryFilter = EVERYTHING) -> DataFrame:
    """Band counts as (status, count) rows, empty bands left out."""
    named = inventory_kpis(star, flt).select(
        F.col("in_stock").alias(IN_STOCK),
        F.col("low_stock").alias(LOW_STOCK),
        F.col("out_of_stock").alias(OUT_OF_STOCK),
    )
    return named.unpivot([], [IN_STOCK, LOW_STOCK, OUT_OF_STOCK], "status", "count").where(
        F.col("count") > 0
    )


def inventory_catalog(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    """The filtered inventory by category and name, with status and status text."""
    return (
        inventory(star, flt, target)
        .select(
            "product_id",
            "product_name",
            "category",
            "price",
            "stock",
            "stock_status",
            "target_stock",
            "suggested_reorder",
            "est_reorder_cost",
        )
        .orderBy(
            F.asc_nulls_last("category"),
            F.asc_nulls_last("product_name"),
            F.asc_nulls_last("product_id"),
        )
        .select("*", catalog_label(F.col("stock")).alias("status_label"))
    )


def _restock_scope(star: Star, flt: InventoryFilter, target: int) -> DataFrame:
    """Filtered products in the two urgent severities, which are exactly the attention band."""
    urgent = InventoryFilter(band=StockBand.ATTENTION).apply(star.products)
    return inventory(star.replaced(products=urgent), flt, target)


def restock_plan(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    """What to reorder: sold out first, then scarcest, then dearest."""
    return (
        _restock_scope(star, flt, target)
        .select(
            "severity",
            "product_id",
            "product_name",
            "category",
            "price",
            "stock",
            "target_stock",
            "suggested_reorder",
            "est_reorder_cost",
        )
        .orderBy(
            "severity",
            "stock",
            F.desc("price"),
            F.asc_nulls_last("category"),
            F.asc_nulls_last("product_name"),
            F.asc_nulls_last("product_id"),
        )
        .select(urgency_badge(F.col("stock")).alias("urgency"), "*")
    )


def restock_totals(
    star: Star, flt: InventoryFilter = EVERYTHING, target: int = TARGET_DEFAULT
) -> DataFrame:
    """One row: products, units and money of the restock plan."""
    return _restock_scope(star, flt, target).agg(
        rows().alias("skus"),
        _zero_if_none(F.sum("suggested_reorder")).alias("units"),
        _zero_if_none(F.sum("est_reorder_cost")).alias("cost"),
    )
