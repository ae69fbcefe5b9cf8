from decimal import Decimal

import pytest

from tests.stars import one, product, rows, star
from tillscope.filters import InventoryFilter, StockBand
from tillscope.model import Star
from tillscope.operators import inventory


@pytest.fixture(scope="module")
def odd(spark):
    """Stock below, at and above every limit, missing stock, and names with regex signs."""
    return star(
        spark,
        products=[
            product(1, "Pen+ (red)", "Desk", "2.00", -3),
            product(2, "Pen", "Desk", "3.00", 0),
            product(3, "Bag", "Bags", "4.00", 1),
            product(4, "Box", "Bags", "5.00", 10),
            product(5, "Cup 1.5l", "Bags", "6.00", 11),
            product(6, "Cup 125l", "Toys", "7.00", None),
            product(7, None, None, None, 60),
        ],
    )


def test_null_stock_is_in_stock_for_the_sql_status_but_zero_for_the_plan(odd):
    assert rows(inventory.inventory_status(odd)) == [
        ("In Stock", 3),
        ("Low Stock", 3),
        ("Out of Stock", 1),
    ]
    status = {r["product_id"]: r["stock_status"] for r in inventory.inventory(odd).collect()}
    assert status == {
        1: "Low Stock",
        2: "Out of Stock",
        3: "Low Stock",
        4: "Low Stock",
        5: "In Stock",
        6: "Out of Stock",
        7: "In Stock",
    }


def test_bands_leave_out_negative_and_null_stock(odd):
    assert one(inventory.inventory_bands(odd)) == {
        "out_of_stock": 1,
        "low_stock": 2,
        "in_stock": 2,
        "total_products": 7,
    }
    assert one(inventory.low_stock_count(odd)) == {"low_stock": 4}
    assert [r[0] for r in rows(inventory.low_stock(odd))] == [1, 2, 3, 4]


def test_kpis_count_negative_stock_for_reorder_only(odd, spark):
    assert one(inventory.inventory_kpis(odd)) == {
        "skus": 7,
        "categories": 4,
        "in_stock": 2,
        "low_stock": 2,
        "out_of_stock": 2,
        "units_on_hand": 79,
        "reorder_units": 53 + 50 + 49 + 40 + 50,
    }
    assert set(one(inventory.inventory_kpis(star(spark))).values()) == {0}


def test_reorder_arithmetic(odd):
    got = {
        r["product_id"]: (r["suggested_reorder"], r["est_reorder_cost"], r["target_stock"])
        for r in inventory.inventory(odd, target=10).collect()
    }
    assert got[1] == (13, Decimal("26.00"), 10)
    assert got[4] == (0, Decimal("0.00"), 10)
    assert got[6] == (10, Decimal("70.00"), 10)
    assert got[7] == (0, Decimal("0.00"), 10)


@pytest.mark.parametrize("target", [9, 501])
def test_target_outside_the_limits_is_refused(odd, target):
    with pytest.raises(ValueError, match="outside 10..500"):
        inventory.restock_plan(odd, target=target)


def _ids(df):
    return [r["product_id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("flt", "expected"),
    [
        (InventoryFilter(), [1, 2, 3, 4, 5, 6, 7]),
        (InventoryFilter(search="  PEN "), [1, 2]),
        (InventoryFilter(search="^b(ag|ox)$"), [3, 4]),
        (InventoryFilter(search="1.5l"), [5, 6]),
        (InventoryFilter(search="1.5l", literal=True), [5]),
        (InventoryFilter(search="+ (red)", literal=True), [1]),
        (InventoryFilter(category="Bags"), [3, 4, 5]),
        (InventoryFilter(band=StockBand.ATTENTION), [1, 2, 3, 4, 6]),
        (InventoryFilter(band=StockBand.OUT), [2, 6]),
        (InventoryFilter(band=StockBand.LOW), [3, 4]),
        (InventoryFilter(band=StockBand.IN), [5, 7]),
        (InventoryFilter("pen", "Desk", StockBand.OUT), [2]),
        (InventoryFilter("nothing"), []),
    ],
)
def test_filters(odd, flt, expected):
    assert sorted(_ids(inventory.inventory(odd, flt))) == expected


def test_restock_order(spark):
    s = star(
        spark,
        products=[
            product(1, "b", "z", "9.00", 4),
            product(2, "a", "z", "9.00", 4),
            product(3, "c", "a", "10.00", 4),
            product(4, "d", "z", "1.00", 0),
            product(5, "e", "z", "1.00", -1),
            product(6, "f", "z", "1.00", 11),
        ],
    )
    plan = inventory.restock_plan(s)
    assert _ids(plan) == [4, 5, 3, 2, 1]
    assert one(inventory.restock_totals(s)) == {
        "skus": 5,
        "units": 50 + 51 + 46 * 3,
        "cost": 50.0 + 51.0 + 46 * 28.0,
    }
    assert one(inventory.restock_totals(star(spark))) == {"skus": 0, "units": 0, "cost": 0.0}


def test_distribution_leaves_out_empty_bands(odd, spark):
    assert rows(inventory.stock_distribution(odd)) == [
        ("In Stock", 2),
        ("Low Stock", 2),
        ("Out of Stock", 2),
    ]
    only_low = InventoryFilter(band=StockBand.LOW)
    assert rows(inventory.stock_distribution(odd, only_low)) == [("Low Stock", 2)]
    assert rows(inventory.stock_distribution(star(spark))) == []


def test_category_sums(odd):
    assert rows(inventory.stock_by_category(odd)) == [
        ("Bags", 22),
        ("Desk", -3),
        ("Toys", 0),
        (None, 60),
    ]
    assert rows(inventory.inventory_by_category(odd)) == [
        ("Bags", 22, 3),
        ("Toys", 0, 1),
        ("Desk", -3, 2),
    ]


def test_urgent_and_catalog_lists(odd):
    assert rows(inventory.urgent_stock(odd, 2)) == [
        ("Pen+ (red)", "Desk", -3, "Low (-3 units)"),
        ("Pen", "Desk", 0, "Out of Stock"),
    ]
    assert _ids(inventory.inventory_catalog(odd)) == [3, 4, 5, 2, 1, 6, 7]


def test_text_columns_are_read_leniently(spark):
    products = spark.createDataFrame(
        [
            (1, "a", "x", "2.50", "12.7"),
            (2, "b", "x", "cheap", "none"),
            (3, "c", "x", "NaN", "NaN"),
            (4, "d", "x", None, "-1"),
        ],
        "product_id bigint, product_name string, category string, price string, stock string",
    )
    s = Star(None, products, None)
    got = rows(inventory.inventory(s).select("price", "stock", "stock_status").orderBy("product_id"))
    assert got == [
        (2.5, 12, "In Stock"),
        (0.0, 0, "Out of Stock"),
        (0.0, 0, "Out of Stock"),
        (0.0, -1, "Low Stock"),
    ]
    assert sorted(_ids(inventory.inventory(s, InventoryFilter(band=StockBand.OUT)))) == [2, 3]
