"""Small hand-made stars."""

from datetime import date
from decimal import Decimal

from pyspark.sql import types as T

from tillscope.model import CUSTOMERS, PRODUCTS, SALES, Star


def _loose(schema):
    """The contract without NOT NULL, so that bad rows can be built."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _money(value):
    return None if value is None else Decimal(value)


def product(product_id, name="Pen", category="Desk", price="2.00", stock=20):
    return (product_id, name, category, _money(price), stock)


def customer(customer_id, name="Ann", rate="4.00"):
    return (customer_id, name, _money(rate))


def sale(sale_id, day="2024-01-15", customer_id=1, product_id=1, quantity=1, amount="2.00"):
    when = None if day is None else date.fromisoformat(day)
    return (sale_id, when, customer_id, product_id, quantity, _money(amount))


def star(spark, sales=(), products=(), customers=()):
    return Star(
        spark.createDataFrame(list(sales), _loose(SALES)),
        spark.createDataFrame(list(products), _loose(PRODUCTS)),
        spark.createDataFrame(list(customers), _loose(CUSTOMERS)),
    )


def rows(df):
    """Rows as tuples in result order, decimals as float to keep the expectations short."""
    return [
        tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in df.collect()
    ]


def one(df):
    """The only row, as a dict."""
    (row,) = df.collect()
    return {k: float(v) if isinstance(v, Decimal) else v for k, v in row.asDict().items()}
