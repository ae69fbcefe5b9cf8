from datetime import date

import pytest

from tests.stars import customer, one, product, rows, sale, star
from tillscope.filters import SalesFilter
from tillscope.operators import customers, products

JANUARY = SalesFilter(date(2024, 1, 1), date(2024, 1, 31))


@pytest.fixture(scope="module")
def shop(spark):
    """Two products and two customers share a name; one sale has no product, one no customer."""
    return star(
        spark,
        [
            sale(1, quantity=3, amount="30.00"),
            sale(2, product_id=2, quantity=2, amount="5.00"),
            sale(3, product_id=3, customer_id=2, quantity=5, amount="35.00"),
            sale(4, product_id=3, customer_id=3, quantity=0, amount="1.00", day="2024-02-01"),
            sale(5, product_id=9, customer_id=3, quantity=50, amount="500.00"),
            sale(6, product_id=1, customer_id=9, quantity=1, amount="2.00"),
        ],
        [
            product(1, "Pen", "Desk"),
            product(2, "Pen", "Bags"),
            product(3, "Bag", "Bags"),
            product(4, "Unsold", "Toys"),
        ],
        [
            customer(1, "Ann", "4.00"),
            customer(2, "Ann", "5.00"),
            customer(3, "Bob", "3.00"),
            customer(4, "Cy", "1.00"),
        ],
    )


def test_category_revenue(shop):
    assert rows(products.category_revenue(shop)) == [("Bags", 41.0), ("Desk", 32.0)]
    assert rows(products.category_revenue(shop, "Desk")) == [("Desk", 32.0)]
    assert rows(products.category_revenue(shop, "Toys")) == []
    assert rows(products.best_category(shop)) == [("Bags", 41.0)]


def test_category_breakdown(shop):
    assert rows(products.category_breakdown(shop, JANUARY)) == [
        ("Bags", 40.0, 7, 2, 40.0 / 72.0 * 100),
        ("Desk", 32.0, 4, 2, 32.0 / 72.0 * 100),
    ]
    assert rows(products.category_coverage(shop)) == [("Bags", 3, 7, 41.0), ("Desk", 2, 4, 32.0)]


def test_products_are_merged_by_name(shop):
    assert rows(products.units_by_product(shop).orderBy("product_name")) == [("Bag", 5), ("Pen", 6)]
    assert rows(products.top_products_by_units(shop, n=1)) == [("Pen", 6)]
    assert rows(products.best_product(shop)) == [("Pen", 6)]
    assert rows(products.top_products_by_units(shop, "Bags")) == [("Bag", 5), ("Pen", 2)]
    assert rows(products.product_performance(shop)) == [
        ("Bag", "Bags", 5, 36.0),
        ("Pen", "Desk", 4, 32.0),
        ("Pen", "Bags", 2, 5.0),
    ]
    assert rows(products.top_products_by_revenue(shop, JANUARY, 2)) == [
        ("Bag", "Bags", 35.0, 5),
        ("Pen", "Desk", 32.0, 4),
    ]


def test_ties_are_ranked_by_name(spark):
    s = star(
        spark,
        [sale(i, product_id=i, customer_id=i) for i in (1, 2, 3)],
        [product(1, "c", "z"), product(2, "a", "y"), product(3, "b", "x")],
        [customer(1, "c"), customer(2, "a"), customer(3, "b")],
    )
    assert rows(products.top_products_by_units(s, n=2)) == [("a", 1), ("b", 1)]
    assert rows(products.category_revenue(s)) == [("x", 2.0), ("y", 2.0), ("z", 2.0)]
    assert rows(customers.top_customers(s, 2)) == [("a", 2.0), ("b", 2.0)]


def test_customer_kpis(shop, spark):
    assert one(customers.customer_kpis(shop)) == {
        "total_customers": 4,
        "avg_rating": 3.25,
        "avg_order": 95.5,
        "repeat_customers": 2,
    }
    assert one(customers.customer_kpis(star(spark))) == {
        "total_customers": 0,
        "avg_rating": 0.0,
        "avg_order": 0.0,
        "repeat_customers": 0,
    }


def test_active_customer_rating_counts_each_buyer_once(shop, spark):
    assert one(customers.active_customer_rating(shop, JANUARY)) == {"avg_rating": 4.5}
    bags = SalesFilter(category="Bags")
    assert one(customers.active_customer_rating(shop, bags)) == {"avg_rating": 4.0}
    assert one(customers.active_customer_rating(star(spark), JANUARY)) == {"avg_rating": 0.0}


def test_rankings_by_customer_name(shop):
    assert rows(customers.top_customers(shop)) == [("Bob", 501.0), ("Ann", 70.0)]
    assert rows(customers.top_customers_in_period(shop, JANUARY)) == [
        ("Ann", 35.0, 2, 4.0),
        ("Ann", 35.0, 1, 5.0),
    ]


def test_summary_keeps_customers_without_sales(shop):
    assert rows(customers.customer_summary(shop)) == [
        ("Bob", 2, 501.0, 250.5),
        ("Ann", 3, 70.0, 23.33),
        ("Cy", 0, 0.0, 0.0),
    ]


def test_rating_distribution(shop):
    assert rows(customers.rating_distribution(shop)) == [(1.0, 1), (3.0, 1), (4.0, 1), (5.0, 1)]


def test_recent_sales_newest_first(shop):
    got = rows(customers.recent_sales(shop, 3))
    assert got == [
        (4, date(2024, 2, 1), 1.0),
        (1, date(2024, 1, 15), 30.0),
        (2, date(2024, 1, 15), 5.0),
    ]
