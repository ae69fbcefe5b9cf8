import csv
import os
from datetime import date
from pathlib import Path

import pytest

from tests.stars import customer, one, product, rows, sale, star
from tillscope.filters import SalesFilter
from tillscope.model import CONTRACTS
from tillscope.operators import customers, kpis, products, trends, views
from tillscope.operators.quality import QualityError, schema_report
from tillscope.plans.registry import QUERIES
from tillscope.sources.order_tables import load_order_tables
from tillscope.sources.refresh import current_version, ingest_star, load_current_star, write_star
from tillscope.sources.reports import write_report
from tillscope.sources.stars import KeyRange, jdbc_options, load_star, load_star_jdbc

ORDER_TABLES = "/root/testdata/sf0.001"


def _write_csv(folder: Path, **tables: str) -> str:
    for name, text in tables.items():
        (folder / name).mkdir(parents=True)
        (folder / name / "part-0.csv").write_text(text, encoding="utf-8")
    return str(folder)


PRODUCTS = 'product_id,product_name,category,price,stock\n1,"Pen, ""fine""",Desk,2.50,3\n2,Bag,Bags,10.00,0\n'
CUSTOMERS = "customer_id,customer_name,rate\n1,Ann,4.50\n"
SALES = (
    "sale_id,sale_date,customer_id,product_id,quantity,total_amount\n"
    "1,2023-12-31,1,1,2,5.00\n2,2024-01-01,1,2,1,10.00\n"
)


def test_ingest_replaces_all_tables_together(spark, tmp_path):
    first = _write_csv(tmp_path / "a", products=PRODUCTS, customers=CUSTOMERS, sales=SALES)
    target = str(tmp_path / "star")
    ingest_star(spark, first, target)
    loaded = load_current_star(spark, target)
    assert rows(loaded.products.orderBy("product_id"))[0] == (1, 'Pen, "fine"', "Desk", 2.5, 3)
    assert one(kpis.total_kpis(loaded))["total_revenue"] == 15.0

    second = _write_csv(
        tmp_path / "b",
        products=PRODUCTS,
        customers=CUSTOMERS,
        sales=SALES.splitlines()[0] + "\n9,2024-05-05,1,2,3,30.00\n",
    )
    ingest_star(spark, second, target)
    assert one(kpis.total_kpis(load_current_star(spark, target)))["total_revenue"] == 30.0


def test_failed_checks_leave_the_old_star_current(spark, tmp_path):
    good = _write_csv(tmp_path / "a", products=PRODUCTS, customers=CUSTOMERS, sales=SALES)
    target = str(tmp_path / "star")
    ingest_star(spark, good, target)
    version = current_version(spark, target)
    orphan = SALES + "3,2024-02-02,77,1,1,2.50\n"
    bad = _write_csv(tmp_path / "b", products=PRODUCTS, customers=CUSTOMERS, sales=orphan)
    with pytest.raises(QualityError, match="sales.unknown_customer=1"):
        ingest_star(spark, bad, target)
    assert current_version(spark, target) == version
    ingest_star(spark, bad, target, allowed=frozenset({"unknown_customer"}))
    assert current_version(spark, target) > version


@pytest.mark.parametrize(
    "sales",
    [
        SALES.replace("5.00", "much"),
        SALES.replace("2023-12-31", "yesterday"),
        SALES.replace("sale_id,sale_date", "sale_date,sale_id"),
    ],
)
def test_csv_that_breaks_the_contract_is_refused(spark, tmp_path, sales):
    source = _write_csv(tmp_path / "a", products=PRODUCTS, customers=CUSTOMERS, sales=sales)
    with pytest.raises(Exception, match="(?i)malformed|header"):
        ingest_star(spark, source, str(tmp_path / "star"))
    assert not (tmp_path / "star" / "commits").exists()


def test_nothing_committed_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no committed star"):
        current_version(spark, str(tmp_path))
    (tmp_path / "commits").mkdir()
    with pytest.raises(ValueError, match="no committed star"):
        current_version(spark, str(tmp_path))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "star")
    days = ["2022-05-05", "2023-12-31", "2024-01-01", "2024-03-01", "2025-07-07"]
    write_star(
        star(
            spark,
            [sale(i, day, amount=f"{i}.00") for i, day in enumerate(days, start=1)],
            [product(1)],
            [customer(1)],
        ),
        path,
    )
    return path


def test_sales_are_stored_by_year_and_pruned_by_date(spark, stored):
    assert sorted(p for p in os.listdir(f"{stored}/sales") if "=" in p) == [
        f"sale_year={y}" for y in (2022, 2023, 2024, 2025)
    ]
    loaded = load_star(spark, stored)
    around_new_year = SalesFilter(date(2023, 6, 1), date(2024, 2, 1))
    lines = around_new_year.on_sales(loaded.sales)
    assert sorted(r["sale_id"] for r in lines.collect()) == [2, 3]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in plan
    assert "(sale_year#" in plan.split("PartitionFilters")[1]
    assert "PushedFilters: [IsNotNull(sale_date), GreaterThanOrEqual(sale_date,2023-06-01)" in plan
    assert one(kpis.period_kpis(loaded, around_new_year))["revenue"] == 5.0
    assert rows(trends.revenue_by_year(loaded))[0] == (2022, 1.0)


def test_stored_types_meet_the_contract(spark, stored):
    assert rows(schema_report(spark, load_star(spark, stored, as_stored=True))) == []
    with pytest.raises(ValueError, match="only Parquet"):
        load_star(spark, stored, "csv", as_stored=True)
    with pytest.raises(ValueError, match="unknown format"):
        load_star(spark, stored, "xml")


def test_a_large_year_is_split_and_small_ones_are_not(spark, tmp_path):
    sales = spark.range(200_000).selectExpr(
        "id AS sale_id",
        "date_add(CASE WHEN id % 3 = 0 THEN DATE'2024-01-01' ELSE DATE'2001-01-01' + INTERVAL 1 YEAR"
        " * (id % 20) END, cast(id % 365 AS int)) AS sale_date",
        "1L AS customer_id",
        "1L AS product_id",
        "1 AS quantity",
        "cast(1 AS decimal(12,2)) AS total_amount",
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        base = star(spark, [], [product(1)], [customer(1)])
        write_star(type(base)(sales, base.products, base.customers), str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {
        p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "s" / "sales").glob("sale_year=*")
    }
    assert files["sale_year=2024"] > 1
    assert min(files.values()) == 1
    assert load_star(spark, str(tmp_path / "s")).sales.count() == 200_000


def _csv_rows(path: Path) -> list[list[str]]:
    parts = sorted(path.glob("part-*.csv"))
    out = []
    for part in parts:
        with part.open(encoding="utf-8", newline="") as f:
            lines = list(csv.reader(f))
        assert not out or lines[0] == out[0]
        out += lines if not out else lines[1:]
    return out


def test_reports_are_read_back(spark, tmp_path):
    s = star(
        spark,
        [sale(1, amount="2.00"), sale(2, "2024-01-16", amount="3.00")],
        [product(1, 'Pen, "fine"', "Desk", "2.00", 4), product(2, "Bag", "Bags", "9.00", 0)],
        [customer(1), customer(2, "Bob")],
    )
    write_report(customers.customer_summary(s), str(tmp_path / "customers"))
    assert _csv_rows(tmp_path / "customers") == [
        ["customer_name", "orders", "total_spent", "avg_purchase"],
        ["Ann", "2", "5.00", "2.50"],
        ["Bob", "0", "0.00", "0.00"],
    ]
    write_report(views.inventory_report(s), str(tmp_path / "inventory"))
    assert _csv_rows(tmp_path / "inventory") == [
        [
            "Product ID",
            "Product Name",
            "Category",
            "Unit Price (INR)",
            "Current Stock",
            "Stock Status",
            "Target Stock Level",
            "Suggested Reorder Qty",
            "Estimated Restock Cost (INR)",
        ],
        ["2", "Bag", "Bags", "9.00", "0", "Out of Stock", "50", "50", "450.00"],
        ["1", 'Pen, "fine"', "Desk", "2.00", "4", "Low Stock", "50", "46", "92.00"],
    ]
    write_report(views.sales_report(s), str(tmp_path / "sales"))
    assert _csv_rows(tmp_path / "sales") == [
        ["sale_id", "sale_date", "customer_id", "product_id", "quantity", "total_amount"],
        ["2", "2024-01-16", "1", "1", "1", "3.00"],
        ["1", "2024-01-15", "1", "1", "1", "2.00"],
    ]
    assert len(list((tmp_path / "sales").glob("part-*.csv"))) == 1


def test_jdbc_options():
    keys = KeyRange("sale_id", "1", "1000", 16)
    assert jdbc_options("sales", "jdbc:postgresql://h/d", {"user": "u"}, keys) == {
        "url": "jdbc:postgresql://h/d",
        "dbtable": "sales",
        "customSchema": "sale_id bigint, sale_date date, customer_id bigint, product_id bigint, "
        "quantity int, total_amount decimal(12,2)",
        "fetchsize": "10000",
        "user": "u",
        "partitionColumn": "sale_id",
        "lowerBound": "1",
        "upperBound": "1000",
        "numPartitions": "16",
    }
    assert "partitionColumn" not in jdbc_options("customers", "jdbc:x")


@pytest.mark.parametrize(
    ("ranged", "small", "missing"),
    [
        ([], [], "sales"),
        ([], ["sales", "products", "customers"], "sales"),
        (["sales"], [], "products"),
        (["sales"], ["products"], "customers"),
        (["sales", "customers"], [], "products"),
    ],
)
def test_jdbc_tables_need_a_key_range(ranged, small, missing):
    ranges = {name: KeyRange("k", "1", "9", 3) for name in ranged}
    with pytest.raises(ValueError, match=f"{missing} needs a KeyRange"):
        load_star_jdbc(None, "jdbc:x", key_ranges=ranges, small=small)


class _Recorder:
    """Stands in for spark.read and notes what would be loaded."""

    def __init__(self):
        self.loaded = []

    @property
    def read(self):
        return self

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.loaded.append(options)
        return self

    def load(self):
        return self.loaded[-1]["dbtable"]


def test_jdbc_reads_the_three_tables():
    recorder = _Recorder()
    ranges = {"sales": KeyRange("sale_id", "1", "9", 3), "customers": KeyRange("customer_id", "1", "9", 2)}
    loaded = load_star_jdbc(recorder, "jdbc:x", {"user": "u"}, ranges, small={"products"})
    assert {name: loaded.table(name) for name in CONTRACTS} == {name: name for name in CONTRACTS}
    parts = {o["dbtable"]: o.get("numPartitions") for o in recorder.loaded}
    assert parts == {"sales": "3", "customers": "2", "products": None}


@pytest.fixture(scope="module")
def order_star_twice(spark, tmp_path_factory):
    """The order tables as a joined star, and the same star stored and read back."""
    joined = load_order_tables(spark, ORDER_TABLES)
    path = str(tmp_path_factory.mktemp("orders") / "star")
    write_star(joined, path)
    return joined, load_star(spark, path)


@pytest.mark.skipif(not Path(ORDER_TABLES).is_dir(), reason="no driver tables here")
@pytest.mark.parametrize(
    "name",
    [
        "total_kpis",
        "year_range",
        "period_comparison_category",
        "trend_daily",
        "revenue_by_year_quarter",
        "category_breakdown",
        "product_performance",
        "customer_kpis",
        "customer_summary",
        "top_customers_period",
        "restock_plan",
        "olap_pivot",
        "executive_insights",
        "quality_report",
        "sales_report",
    ],
)
def test_a_stored_star_gives_the_same_results(order_star_twice, name):
    joined, stored_star = order_star_twice
    query = QUERIES[name]
    assert query(stored_star).columns == query(joined).columns
    assert sorted(map(repr, rows(query(stored_star)))) == sorted(map(repr, rows(query(joined))))


def test_csv_star_answers_queries(spark, tmp_path):
    source = _write_csv(tmp_path / "a", products=PRODUCTS, customers=CUSTOMERS, sales=SALES)
    loaded = load_star(spark, source, "csv")
    assert rows(products.category_revenue(loaded)) == [("Bags", 10.0), ("Desk", 5.0)]
