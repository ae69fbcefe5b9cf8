"""A star over order-processing tables (part, customer, orders, lineitem).

The tables have no stock, rating or decimal money, so those columns are defined here:

* products:  part; category is the part type, stock the part size minus one
* customers: customer; rate runs through 1.00 .. 5.00 by key
* sales:     lineitem JOIN orders; sale_id is the order key, so one sale may have several lines
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.model import Star

# Only the columns that the mapping uses. Given schemas also spare the job that would infer them.
PART = "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double"
CUSTOMER = "c_custkey bigint, c_name string"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"
LINEITEM = "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double"


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{table}.parquet")


def _money(amount: Column, type_: str) -> Column:
    """A double holding whole hundredths as decimal.

    Going through the integer number of hundredths costs about half of a direct cast, which turns
    every double into text and back.
    """
    hundredths = F.rint(amount * 100).cast("bigint").cast("decimal(14,0)")
    return (hundredths * F.lit(Decimal("0.01"))).cast(type_)


def _products(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "part", PART).select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        _money(F.col("p_retailprice"), "decimal(10,2)").alias("price"),
        (F.col("p_size") - 1).alias("stock"),
    )


def _customers(spark: SparkSession, path: str) -> DataFrame:
    tenths = (F.col("c_custkey") % 41 + 10).cast("decimal(3,0)")
    return _read(spark, path, "customer", CUSTOMER).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        (tenths * F.lit(Decimal("0.1"))).cast("decimal(3,2)").alias("rate"),
    )


def _sales(spark: SparkSession, path: str) -> DataFrame:
    lines = _read(spark, path, "lineitem", LINEITEM)
    # Dates are cut once per order, before the join multiplies them; date filters still reach the scan.
    orders = _read(spark, path, "orders", ORDERS).select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("sale_date")
    )
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("sale_id"),
        "sale_date",
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _money(F.col("l_extendedprice"), "decimal(12,2)").alias("total_amount"),
    )


def load_order_tables(spark: SparkSession, path: str) -> Star:
    """The star over a folder of order tables. A table is opened when it is first asked for."""
    return Star(*(partial(open_, spark, path) for open_ in (_sales, _products, _customers)))
