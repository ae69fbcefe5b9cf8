"""Table contracts of the star schema and the bundle that carries the three tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType(), False),
        T.StructField("product_name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("price", T.DecimalType(10, 2), False),
        T.StructField("stock", T.IntegerType(), False),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("customer_name", T.StringType(), False),
        T.StructField("rate", T.DecimalType(3, 2), False),
    ]
)

SALES = T.StructType(
    [
        T.StructField("sale_id", T.LongType(), False),
        T.StructField("sale_date", T.DateType(), False),
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("product_id", T.LongType(), False),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("total_amount", T.DecimalType(12, 2), False),
    ]
)

CONTRACTS = {"products": PRODUCTS, "customers": CUSTOMERS, "sales": SALES}
PRIMARY_KEYS = {"products": "product_id", "customers": "customer_id", "sales": "sale_id"}

# Partition column of the stored sales layout; derived from sale_date, not part of the contract.
SALE_YEAR = "sale_year"

# The type of a sales amount.
AMOUNT = "decimal(12,2)"

# Wide enough for any sum of decimal(12,2) amounts, narrow enough to multiply exactly.
MONEY_SUM = "decimal(32,2)"

Table = DataFrame | Callable[[], DataFrame]


class Star:
    """The fact table and its two dimensions. All operators take one of these.

    A table may be given as a function that opens it; it is called when an operator first asks for the table.
    """

    def __init__(self, sales: Table, products: Table, customers: Table):
        self._tables = {"sales": sales, "products": products, "customers": customers}

    def table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if callable(table) and not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    @property
    def sales(self) -> DataFrame:
        return self.table("sales")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    def parts(self, key: str) -> list[DataFrame]:
        """The fact in one or more parts, no key in two of them, as it is best joined by `key`."""
        return [self.sales]

    @property
    def summed(self) -> DataFrame:
        """The fact, or sums of it by day and product where they are stored, for measures that add up and for dates."""
        return self.sales

    def summed_parts(self, key: str) -> list[DataFrame]:
        """As `parts`, for measures that add up."""
        return self.parts(key)

    def replaced(self, **tables: Table) -> Star:
        """This star with other tables under the given names; those that stay are not opened."""
        return Star(**{**{name: partial(self.table, name) for name in self._tables}, **tables})
