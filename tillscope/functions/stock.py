"""Stock classification, replenishment arithmetic and stock labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Band limit, status names and the badge texts shown in reports.
LOW_STOCK_LIMIT = 10
OUT_OF_STOCK = "Out of Stock"
LOW_STOCK = "Low Stock"
IN_STOCK = "In Stock"
BADGE_CRITICAL = "🔴 Critical (Out of Stock)"
BADGE_URGENT = "🟡 Urgent (Low Stock)"
CATALOG_OUT = "🔴 Out of Stock"
CATALOG_LOW = "🟡 Low (%d left)"
CATALOG_IN = "🟢 In Stock (%d units)"
ALERT_LOW = "Low (%d units)"

# Limits and default of the replenishment target.
TARGET_MIN, TARGET_MAX, TARGET_DEFAULT = 10, 500, 50


def _by_band(stock: Column, out: Column, low: Column, healthy: Column) -> Column:
    """First matching band; negative stock falls in the low one."""
    return F.when(stock == 0, out).when(stock <= LOW_STOCK_LIMIT, low).otherwise(healthy)


def stock_status(stock: Column) -> Column:
    return _by_band(stock, F.lit(OUT_OF_STOCK), F.lit(LOW_STOCK), F.lit(IN_STOCK))


def severity(stock: Column) -> Column:
    return _by_band(stock, F.lit(1), F.lit(2), F.lit(3))


def urgency_badge(stock: Column) -> Column:
    return F.when(stock == 0, BADGE_CRITICAL).otherwise(BADGE_URGENT)


def catalog_label(stock: Column) -> Column:
    return _by_band(
        stock,
        F.lit(CATALOG_OUT),
        F.format_string(CATALOG_LOW, stock),
        F.format_string(CATALOG_IN, stock),
    )


def alert_label(stock: Column) -> Column:
    return F.when(stock == 0, OUT_OF_STOCK).otherwise(F.format_string(ALERT_LOW, stock))


def suggested_reorder(stock: Column, target: int) -> Column:
    return F.greatest(F.lit(0), F.lit(target) - stock)


def check_target(target: int) -> int:
    if not TARGET_MIN <= target <= TARGET_MAX:
        raise ValueError(f"target stock {target} is outside {TARGET_MIN}..{TARGET_MAX}")
    return target


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _parsed(name: str) -> Column:
    """Text as double; what does not parse, and NaN, is null."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def whole_units(df: DataFrame, name: str) -> Column:
    """A unit count; text is parsed leniently and cut to whole units, and stays null if it is no number."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name)
    value = F.col(name) if _is_number(df, name) else _parsed(name)
    return value.try_cast("int")


def unit_price(df: DataFrame, name: str) -> Column:
    return F.col(name) if _is_number(df, name) else _parsed(name)
