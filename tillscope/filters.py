"""Validated filter values. They turn into pushed-down predicates, never into collected data."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from enum import Enum
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.calendar import month_number
from tillscope.functions.stock import LOW_STOCK_LIMIT, whole_units
from tillscope.model import SALE_YEAR

# Sentinel that switches a category or month filter off.
ALL = "All"


def conjunction(predicates: list[Column]) -> Column:
    """AND of any number of predicates; true when there are none."""
    return reduce(and_, predicates, F.lit(True))


@dataclass(frozen=True)
class SalesFilter:
    """Inclusive date range plus optional category. An open end is None."""

    start: date | None = None
    end: date | None = None
    category: str = ALL

    def __post_init__(self) -> None:
        if self.start and self.end and self.start > self.end:
            raise ValueError(f"start {self.start} is after end {self.end}")

    @property
    def days(self) -> int:
        if self.start is None or self.end is None:
            raise ValueError("an open date range has no length")
        return (self.end - self.start).days + 1

    def prior(self) -> SalesFilter:
        """The range of the same length that ends the day before this one starts."""
        days = self.days
        last = self.start - timedelta(days=1)
        return replace(self, start=last - timedelta(days=days - 1), end=last)

    def on_sales(self, sales: DataFrame) -> DataFrame:
        """Date predicates, doubled on the year partition column where the layout has one."""
        predicates = []
        stored_by_year = SALE_YEAR in sales.columns
        if self.start:
            predicates.append(F.col("sale_date") >= F.lit(self.start))
            if stored_by_year:
                predicates.append(F.col(SALE_YEAR) >= self.start.year)
        if self.end:
            predicates.append(F.col("sale_date") <= F.lit(self.end))
            if stored_by_year:
                predicates.append(F.col(SALE_YEAR) <= self.end.year)
        return sales.where(conjunction(predicates)) if predicates else sales

    def on_products(self, products: DataFrame) -> DataFrame:
        if self.category == ALL:
            return products
        return products.where(F.col("category") == self.category)


def month_predicate(month: str) -> list[Column]:
    """Predicates for one month name in any year; compares numbers, so nothing is formatted per row."""
    if month == ALL:
        return []
    number = month_number(month)
    return [F.lit(False) if number is None else F.month("sale_date") == number]


class StockBand(Enum):
    ALL = "all"
    ATTENTION = "attention"
    OUT = "out"
    LOW = "low"
    IN = "in"

    def predicate(self, stock: Column) -> Column | None:
        """Predicate on raw stock, in which null counts as zero units.

        The null test is spelled out instead of coalescing, so that it still reaches the scan.
        """
        if self is StockBand.ATTENTION:
            return stock.isNull() | (stock <= LOW_STOCK_LIMIT)
        if self is StockBand.OUT:
            return stock.isNull() | (stock == 0)
        if self is StockBand.LOW:
            return (stock > 0) & (stock <= LOW_STOCK_LIMIT)
        if self is StockBand.IN:
            return stock > LOW_STOCK_LIMIT
        return None


@dataclass(frozen=True)
class InventoryFilter:
    """Name search (a regular expression unless literal), category and stock band."""

    search: str = ""
    category: str = ALL
    band: StockBand = StockBand.ALL
    literal: bool = False

    def apply(self, products: DataFrame) -> DataFrame:
        predicates = []
        wanted = self.search.strip().lower()
        if wanted:
            name = F.lower("product_name")
            found = name.contains(wanted) if self.literal else name.rlike(wanted)
            predicates.append(F.coalesce(found, F.lit(False)))
        if self.category != ALL:
            predicates.append(F.col("category") == self.category)
        in_band = self.band.predicate(whole_units(products, "stock"))
        if in_band is not None:
            predicates.append(in_band)
        return products.where(conjunction(predicates)) if predicates else products
