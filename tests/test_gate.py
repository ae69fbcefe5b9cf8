"""Row rules are counted while a star is written; the files are read again for keys and references only."""

import re

import pytest

from tests.stars import customer, one, product, sale, star
from tests.test_quality import EXPECTED, bad  # noqa: F401
from tests.test_scale import final_plan, no_broadcast
from tillscope.model import Star
from tillscope.operators import quality
from tillscope.sources.refresh import gated_write, write_star
from tillscope.sources.scratch import working_folder
from tillscope.sources.stars import load_star


def scans(text, column):
    """The columns that each scan of the files with `column` reads."""
    found = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    columns = [[c for c in re.sub(r"#\d+L?", "", f).split(",") if c != "sale_year"] for f in found]
    return sorted(c for c in columns if column in c)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_a_written_star_has_the_same_report(spark, bad, threshold):  # noqa: F811
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {(r["table_name"], r["check"]): r["violations"] for r in gated_write(bad).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 24 and {k: v for k, v in found.items() if v} == EXPECTED


def test_the_write_counts_rows_and_rules(spark, bad, tmp_path):  # noqa: F811
    counted = write_star(bad, str(tmp_path / "s"))
    assert {t: c["row_count"] for t, c in counted.items()} == {"sales": 8, "products": 3, "customers": 4}
    assert {t: (c["key_min"], c["key_max"]) for t, c in counted.items()} == {"sales": (1, 6), "products": (1, 2), "customers": (1, 3)}
    row_wise = {(t, name): n for t, c in counted.items() for name, n in c.items() if name not in ("row_count", "key_min", "key_max") and n}
    references = {"duplicate_key", "unknown_customer", "unknown_product", "amount_not_quantity_x_price"}
    assert row_wise == {k: v for k, v in EXPECTED.items() if k[1] not in references}
    empty = write_star(star(spark), str(tmp_path / "e"))
    assert {n for c in empty.values() for n in c.values()} == {0, None} and not any(map(quality.are_dense, empty.values()))


def test_the_gate_reads_keys_and_references_only(spark, tmp_path):
    path = str(tmp_path / "s")
    counted = write_star(star(spark, [sale(1), sale(2)], [product(1)], [customer(1)]), path)
    written = load_star(spark, path)
    assert scans(final_plan(quality.quality_report(written, counted)), "customer_id") == [["customer_id"], ["customer_id"], ["customer_id", "product_id", "quantity", "total_amount"]]
    text = final_plan(quality.quality_report(written, counted))
    assert scans(text, "sale_id") == [["sale_id"]]
    for column in ("sale_date", "rate", "stock", "customer_name", "product_name", "category"):
        assert scans(text, column) == []
    with no_broadcast(spark):
        text = final_plan(quality.quality_report(written, counted))
        assert scans(text, "sale_date") == [] and scans(text, "quantity") == [["product_id", "quantity", "total_amount"]]


def test_duplicate_products_count_a_line_once(spark):
    prices = [product(1, price="2.00"), product(1, price="3.00"), product(1, price=None), product(2, price=None), product(2, price=None)]
    s = star(spark, [sale(1, quantity=0, amount="2.00"), sale(2, product_id=2, amount="-1.00"), sale(3, product_id=9, customer_id=9)], prices, [customer(1), customer(1)])
    found = {r["check"]: r["violations"] for r in quality.quality_report(s).where("table_name = 'sales'").collect()}
    with no_broadcast(spark):
        assert {r["check"]: r["violations"] for r in quality.quality_report(s).where("table_name = 'sales'").collect()} == found
    want = {"quantity_not_positive": 1, "negative_amount": 1, "unknown_product": 1, "unknown_customer": 1, "amount_not_quantity_x_price": 2}
    assert {k: v for k, v in found.items() if v} == want


def test_a_table_is_opened_when_it_is_asked_for():
    opened = []
    s = Star(*(lambda name=name: opened.append(name) or name for name in ("sales", "products", "customers")))
    assert not opened
    other = s.replaced(products="p")
    assert (other.products, other.customers, other.customers, s.customers) == ("p", "customers", "customers", "customers")
    assert opened == ["customers"]


def test_working_folder_is_shared(spark):
    class Elsewhere:
        """A session on a cluster without a shared folder."""

        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="all executors share"):
        working_folder(Elsewhere, "x")
    assert working_folder(spark, "x") != working_folder(spark, "x")


@pytest.mark.parametrize(
    "keys",
    [
        "id",
        "id % 40000",
        "id - 50000",
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id END",
        "CASE WHEN id = 99999 THEN 3 WHEN id % 1000 = 0 THEN NULL ELSE id END",
        "id * 65",
        "CASE WHEN id < 4 THEN 9223372036854775807 ELSE -id END",
    ],
)
def test_bitmaps_count_the_keys_that_repeat(spark, keys):
    sales = spark.range(100_000).selectExpr(f"CAST({keys} AS BIGINT) AS sale_id").repartition(6)
    want = one(quality.duplicate_keys(Star(sales, None, None), "sales"))["duplicate_key"]
    assert quality.count_duplicates(sales, "sale_id") == want


def test_bitmaps_send_stretches_and_not_keys(spark):
    """A task sends a row for each stretch of keys that it has met."""
    keys = spark.range(0, 1_000_000, 1, 4).selectExpr("id AS sale_id")
    assert quality.suspect_stretches(keys, "sale_id").count() == 0
    twice = keys.union(spark.createDataFrame([(700_000,), (700_000,)], "sale_id BIGINT"))
    assert [r.stretch for r in quality.suspect_stretches(twice, "sale_id").collect()] == [22]
    text = final_plan(quality.suspect_stretches(twice, "sale_id"))
    exchange, below = text.index("Exchange hashpartitioning("), text.index("partial_bitmap_construct_agg")
    assert exchange < below and text.count("Exchange") == 1  # bitmaps are made before anything moves
    assert quality.count_duplicates(twice, "sale_id") == 1


def test_dense_keys():
    assert quality.are_dense({"key_min": 1, "key_max": 6400, "row_count": 100})
    assert not quality.are_dense({"key_min": 0, "key_max": 6400, "row_count": 100})
    assert not quality.are_dense({"key_min": None, "key_max": None, "row_count": 3})
