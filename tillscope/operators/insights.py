"""Structured business insights; texts are derived from the columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.filters import SalesFilter
from tillscope.functions.money import (
    change_label,
    change_pct,
    count_text,
    currency_text,
    percent_text,
    share_pct,
)
from tillscope.model import MONEY_SUM, Star
from tillscope.operators.facts import REVENUE, UNITS, by_product, grand_total
from tillscope.operators.inventory import inventory_bands, low_stock_count
from tillscope.operators.kpis import average_sale, period_pair

LEADER, TOP_SKU, REPLENISH, OPTIMAL, MOMENTUM, VOLUME = (
    "category_leader",
    "top_sku",
    "replenishment",
    "stock_optimal",
    "momentum",
    "volume",
)

# Result columns besides seq and kind. A kind fills the ones it knows and leaves the rest null.
DETAILS = {
    "subject": "string",
    "revenue": MONEY_SUM,
    "pct": "double",
    "units": "bigint",
    "orders": "bigint",
    "customers": "bigint",
    "aov": "double",
    "out_of_stock": "bigint",
    "low_stock": "bigint",
}


def _insight(df: DataFrame, seq: int, kind: Column | str, **details: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    cells = [
        details.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in DETAILS.items()
    ]
    return df.select(F.lit(seq).alias("seq"), kind.alias("kind"), *cells)


def executive_insights(star: Star, flt: SalesFilter) -> DataFrame:
    """Two to four rows: leading category, top product, stock alert, and momentum or volume.

    Leader and top product are both read off one aggregation by (category, name): the branches share
    its exchange, so together they scan the fact once. Momentum is the second scan.
    """
    per_product = by_product(
        star, [REVENUE, UNITS], flt, product_keys=["product_name", "category"]
    )
    per_category = per_product.groupBy("category").agg(
        F.sum("revenue").cast(MONEY_SUM).alias("revenue"), F.sum("units_sold").alias("units_sold")
    )
    total = grand_total(per_category, "revenue", "units_sold").getField("revenue")
    leader = per_category.orderBy(F.desc("revenue"), F.asc_nulls_last("category")).limit(1)
    top_sku = per_product.orderBy(
        F.desc("revenue"), F.asc_nulls_last("product_name"), F.asc_nulls_last("category")
    ).limit(1)
    bands = inventory_bands(star)
    to_restock = F.col("out_of_stock") + F.col("low_stock")
    periods = period_pair(star, flt)
    has_prior = F.col("prior_orders") > 0

    parts = [
        _insight(
            leader,
            1,
            LEADER,
            subject=F.col("category"),
            revenue=F.col("revenue"),
            pct=share_pct(F.col("revenue"), total),
            units=F.col("units_sold"),
        ),
        _insight(
            top_sku,
            2,
            TOP_SKU,
            subject=F.col("product_name"),
            revenue=F.col("revenue"),
            units=F.col("units_sold"),
        ),
        _insight(
            bands,
            3,
            F.when(to_restock > 0, REPLENISH).otherwise(OPTIMAL),
            units=to_restock,
            out_of_stock=F.col("out_of_stock"),
            low_stock=F.col("low_stock"),
        ),
        _insight(
            periods,
            4,
            F.when(has_prior, MOMENTUM).otherwise(VOLUME),
            revenue=F.col("cur_revenue"),
            pct=F.when(has_prior, change_pct(F.col("cur_revenue"), F.col("prior_revenue"))),
            orders=F.col("cur_orders"),
            customers=F.col("cur_customers"),
            aov=F.col("cur_aov"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("seq")


def insight_texts(insights: DataFrame) -> DataFrame:
    """One sentence per row of `executive_insights`."""
    kind, subject = F.col("kind"), F.coalesce("subject", F.lit("N/A"))
    money, aov = currency_text(F.col("revenue")), currency_text(F.col("aov"))
    units, orders, customers, out, low = (
        count_text(F.col(c)) for c in ("units", "orders", "customers", "out_of_stock", "low_stock")
    )

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    share, change = percent_text(F.col("pct")), change_label(F.col("pct"))
    sentences = {
        LEADER: text(subject, " leads with ", money, ", ", share, " of revenue"),
        TOP_SKU: text(subject, " sells most: ", money, " from ", units, " units"),
        REPLENISH: text(units, " products to restock: ", out, " sold out, ", low, " low"),
        OPTIMAL: text("No product needs restocking"),
        MOMENTUM: text("Revenue ", change, ", average order ", aov),
        VOLUME: text(orders, " orders by ", customers, " customers, average order ", aov),
    }
    chosen = F.coalesce(*[F.when(kind == k, sentence) for k, sentence in sentences.items()])
    return insights.select("seq", "kind", chosen.alias("text"))


def olap_insights(star: Star) -> DataFrame:
    """One row: best seller, best category ("N/A" if none), average sale and low-stock count.

    Both winners carry units and revenue, so that they share one aggregation by (name, category).
    """
    per_product = by_product(star, [REVENUE, UNITS], product_keys=["product_name", "category"])

    def winner(key: str, measure: str) -> Column:
        totals = per_product.groupBy(key).agg(
            F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units_sold")
        )
        first = totals.orderBy(F.desc(measure), F.asc_nulls_last(key)).limit(1)
        return first.select(F.struct(key, "revenue", "units_sold")).scalar().getField(key)

    return low_stock_count(star).select(
        F.coalesce(winner("product_name", "units_sold"), F.lit("N/A")).alias("best_product"),
        F.coalesce(winner("category", "revenue"), F.lit("N/A")).alias("best_category"),
        average_sale(star).scalar().alias("avg_order"),
        "low_stock",
    )
