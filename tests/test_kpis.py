from datetime import date

import pytest

from tests.stars import customer, one, product, rows, sale, star
from tillscope.filters import SalesFilter
from tillscope.operators import kpis

JAN_11_20 = SalesFilter(date(2024, 1, 11), date(2024, 1, 20))


def test_empty_star_gives_zeros_and_today(spark):
    empty = star(spark)
    assert one(kpis.total_kpis(empty)) == {
        "total_revenue": 0.0,
        "total_orders": 0,
        "total_products": 0,
        "total_customers": 0,
    }
    assert one(kpis.period_kpis(empty, JAN_11_20)) == {
        "revenue": 0.0,
        "orders": 0,
        "active_customers": 0,
        "aov": 0.0,
    }
    bounds = one(kpis.filter_bounds(empty))
    assert bounds["min_date"] == bounds["max_date"] is not None
    assert rows(kpis.sale_years(empty)) == rows(kpis.year_ranges(empty)) == []
    compared = one(kpis.period_comparison(empty, JAN_11_20))
    assert compared["cur_orders"] == compared["prior_orders"] == 0
    assert compared["revenue_pct"] is None
    assert compared["revenue_label"] == "No previous-period data available"
    assert one(kpis.average_sale(empty)) == {"avg_order": 0.0}


def test_reversed_range_is_refused():
    with pytest.raises(ValueError, match="is after end"):
        SalesFilter(date(2024, 2, 1), date(2024, 1, 1))


def test_prior_period_has_the_same_length_and_ends_the_day_before():
    assert JAN_11_20.days == 10
    assert JAN_11_20.prior() == SalesFilter(date(2024, 1, 1), date(2024, 1, 10))
    year = SalesFilter(date(1997, 1, 1), date(1997, 12, 31))
    assert year.prior() == SalesFilter(date(1996, 1, 2), date(1996, 12, 31))


def test_comparison_counts_every_boundary_day_once(spark):
    days = ["2023-12-31", "2024-01-01", "2024-01-10", "2024-01-11", "2024-01-20", "2024-01-21"]
    s = star(
        spark,
        [sale(i, day, customer_id=i, amount=f"{10 ** i}.00") for i, day in enumerate(days)],
        [product(1)],
    )
    got = one(kpis.period_comparison(s, JAN_11_20))
    assert got["cur_revenue"] == 11_000.0
    assert got["prior_revenue"] == 110.0
    assert (got["cur_orders"], got["prior_orders"]) == (2, 2)
    assert (got["cur_customers"], got["prior_customers"]) == (2, 2)
    assert got["cur_aov"] == 5500.0
    assert got["revenue_pct"] == (11_000.0 - 110.0) / 110.0 * 100
    assert got["revenue_direction"] == "up"
    assert got["orders_direction"] == "neutral"
    assert got["orders_label"] == "0.0% vs previous period"


def test_kpis_count_distinct_sales_and_skip_unknown_products(spark):
    s = star(
        spark,
        [
            sale(1, amount="5.00"),
            sale(1, amount="7.00"),
            sale(2, customer_id=2, amount="8.00"),
            sale(3, customer_id=3, product_id=99, amount="100.00"),
            sale(4, customer_id=3, product_id=2, amount="1.00"),
        ],
        [product(1, category="Desk"), product(2, category="Bags")],
    )
    january = SalesFilter(date(2024, 1, 1), date(2024, 1, 31))
    assert one(kpis.period_kpis(s, january)) == {
        "revenue": 21.0,
        "orders": 3,
        "active_customers": 3,
        "aov": 7.0,
    }
    desk = SalesFilter(january.start, january.end, "Desk")
    assert one(kpis.period_kpis(s, desk))["revenue"] == 20.0
    assert one(kpis.period_kpis(s, SalesFilter(category="Nothing")))["orders"] == 0
    assert one(kpis.total_kpis(s))["total_revenue"] == 121.0


def test_filter_values(spark):
    s = star(
        spark,
        [sale(1, "2023-03-05"), sale(2, "2024-03-01"), sale(3, "2024-11-30")],
        [product(1, category="b"), product(2, category="a"), product(3, category="a")],
    )
    assert rows(kpis.sale_years(s)) == [(2024,), (2023,)]
    assert rows(kpis.categories(s)) == [("a",), ("b",)]
    assert rows(kpis.sale_months(s)) == [("March", 3), ("November", 11)]
    assert rows(kpis.year_ranges(s)) == [
        (2024, date(2024, 1, 1), date(2024, 11, 30)),
        (2023, date(2023, 3, 5), date(2023, 12, 31)),
    ]


def test_filter_for_a_year_is_clamped_to_the_data(spark):
    s = star(spark, [sale(1, "2023-03-05"), sale(2, "2024-11-30")])
    assert kpis.filter_for_year(s) == SalesFilter(date(2024, 1, 1), date(2024, 11, 30))
    assert kpis.filter_for_year(s, 2023) == SalesFilter(date(2023, 3, 5), date(2023, 12, 31))
    everything = kpis.filter_for_year(s, "All Years", "Desk")
    assert everything == SalesFilter(date(2023, 3, 5), date(2024, 11, 30), "Desk")


def test_average_sale_breaks_ties_upwards(spark):
    s = star(spark, [sale(1, amount="1.00"), sale(2, amount="1.01")], [], [customer(1)])
    assert one(kpis.average_sale(s)) == {"avg_order": 1.01}
