"""Customer KPIs, ratings, rankings and the purchase summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.filters import SalesFilter
from tillscope.functions.money import exact_mean, money_sum
from tillscope.model import Star
from tillscope.operators.facts import AMOUNTS, LINES, REVENUE, folded, rollup, rows, sold_lines, together

SPENT = REVENUE.named("total_spent")
ORDERS = LINES.named("orders")


def customer_kpis(star: Star) -> DataFrame:
    """One row: customers, average rating, average sale and customers with more than one sale.

    Average sale and repeat customers come from one pass over the sales, folded by customer.
    """
    people = star.customers.agg(
        F.struct(
            rows().alias("n"), F.sum("rate").alias("total"), F.count("rate").alias("rated")
        ).alias("people")
    ).scalar()
    per_customer = star.sales.groupBy("customer_id").agg(
        rows().alias("lines"),
        money_sum(F.col("total_amount")).alias("spent"),
        F.count("total_amount").alias("amounts"),
    )
    sold = per_customer.agg(
        F.sum("spent").alias("spent"),
        F.coalesce(F.sum("amounts"), F.lit(0)).alias("amounts"),
        F.count_if(F.col("lines") > 1).alias("repeat_customers"),
    ).withColumn("people", people)
    return sold.select(
        F.col("people.n").alias("total_customers"),
        exact_mean(F.col("people.total"), F.col("people.rated")).alias("avg_rating"),
        exact_mean(F.col("spent"), F.col("amounts")).alias("avg_order"),
        "repeat_customers",
    )


def average_rating(star: Star) -> DataFrame:
    """One row: mean rating of all customers, two places, 0 when there are none."""
    return star.customers.agg(exact_mean(F.sum("rate"), F.count("rate")).alias("avg_rating"))


def active_customer_rating(star: Star, flt: SalesFilter) -> DataFrame:
    """One row: mean rating of the customers who bought in the period, each counted once."""
    buyers = sold_lines(star, flt, "customer_id").distinct()
    return average_rating(
        star.replaced(customers=star.customers.join(buyers, "customer_id", "left_semi"))
    )


def rating_distribution(star: Star) -> DataFrame:
    return (
        star.customers.groupBy("rate")
        .agg(rows().alias("total"))
        .orderBy(F.asc_nulls_last("rate"))
    )


def top_customers(star: Star, n: int = 10) -> DataFrame:
    """Customer names by total spend; customers that share a name are one row."""
    totals = rollup(
        star.parts("customer_id"), star.customers, "customer_id", [SPENT], dim_keys=["customer_name"]
    )
    return totals.orderBy(F.desc("total_spent"), F.asc_nulls_last("customer_name")).limit(n)


def top_customers_in_period(star: Star, flt: SalesFilter, n: int = 5) -> DataFrame:
    """(name, rating) pairs by spend on known products in the period."""
    lines = sold_lines(star, flt, "customer_id", "sale_id", "total_amount")
    totals = rollup(
        lines, star.customers, "customer_id", [SPENT, ORDERS], dim_keys=["customer_name", "rate"]
    )
    return (
        totals.select("customer_name", "total_spent", "orders", F.col("rate").alias("rating"))
        .orderBy(
            F.desc("total_spent"), F.asc_nulls_last("customer_name"), F.asc_nulls_last("rating")
        )
        .limit(n)
    )


def customer_summary(star: Star) -> DataFrame:
    """Orders, spend and mean purchase per customer name; names without sales get zeros.

    Sales are folded by customer before the outer join, so a customer with very many sales reaches
    the join as one row.
    """
    measures = [ORDERS, SPENT, AMOUNTS]
    per_customer = together(folded(star.parts("customer_id"), "customer_id", measures))
    per_name = (
        star.customers.select("customer_id", "customer_name")
        .join(per_customer, "customer_id", "left")
        .groupBy("customer_name")
        .agg(*[m.next_step() for m in measures])
        .select("customer_name", *[m.result() for m in measures])
    )
    return per_name.select(
        "customer_name",
        "orders",
        "total_spent",
        exact_mean(F.col("total_spent"), F.col("amounts")).alias("avg_purchase"),
    ).orderBy(F.desc("total_spent"), F.asc_nulls_last("customer_name"))


def recent_sales(star: Star, n: int = 10) -> DataFrame:
    """The newest sales lines: id, date and amount."""
    columns = ["sale_id", "sale_date", "total_amount"]
    return star.sales.select(*columns).orderBy(
        F.desc_nulls_first("sale_date"), F.asc_nulls_last("sale_id"), F.asc_nulls_last("total_amount")
    ).limit(n)
