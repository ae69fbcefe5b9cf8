"""Retail analytics over a sales / products / customers star schema, on Spark."""

from tillscope.filters import ALL, InventoryFilter, SalesFilter, StockBand
from tillscope.model import CUSTOMERS, PRODUCTS, SALES, Star

__all__ = [
    "ALL",
    "CUSTOMERS",
    "InventoryFilter",
    "PRODUCTS",
    "SALES",
    "SalesFilter",
    "Star",
    "StockBand",
]
