"""Plans and strategies that have to hold on large and skewed data."""

import re
from collections import Counter
from contextlib import contextmanager
from datetime import date
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.stars import customer, one, product, rows, star
from tillscope.filters import InventoryFilter, SalesFilter, StockBand
from tillscope.model import Star
from tillscope.operators import customers, insights, inventory, kpis, olap, products, quality, trends
from tillscope.operators.facts import fits_broadcast
from tillscope.plans.oracles import BODIES, ORACLES
from tillscope.plans.registry import QUERIES, on_order_tables
from tillscope.sources.order_tables import load_order_tables

FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no driver tables here")
YEAR = SalesFilter(date(1997, 1, 1), date(1997, 12, 31))


@contextmanager
def settings(spark, **values):
    """Session settings for one block; dots are written as double underscores."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_broadcast(spark, **more):
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        **more,
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan as executed, without the initial plans that adaptive execution prints beside it."""
    df.collect()
    kept, cut = [], None
    for line in plan(df).split("\n"):
        depth = len(re.match(r"[ :|]*", line).group())
        if cut is not None and line.strip():
            if depth > cut or (depth == cut and line[depth : depth + 1] not in "+*"):
                continue
            cut = None
        if "== Initial Plan ==" in line:
            cut = depth
            continue
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in ("part", "customer", "orders", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


FACT_QUERIES = sorted(n for n, body in BODIES.items() if re.search(r"\b(sales|fact)", body))


@with_tables
@pytest.mark.parametrize("name", FACT_QUERIES)
def test_results_do_not_depend_on_broadcasting(spark, oracle, name):
    with no_broadcast(spark):
        df = on_order_tables(QUERIES[name])(spark, FOLDER)
        columns = sorted(df.columns)
        ours = sorted(repr([r[c] for c in columns]) for r in df.collect())
        assert "BroadcastHashJoin" not in plan(df)
    result = oracle.execute(ORACLES[name])
    order = [c[0] for c in result.description]
    theirs = sorted(repr([r[order.index(c)] for c in columns]) for r in result.fetchall())
    assert ours == theirs


@with_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_native_and_free_of_cross_joins(spark, name):
    text = plan(on_order_tables(QUERIES[name])(spark, FOLDER))
    for operator in ("Cartesian", "NestedLoop", "Python", "Pandas", "Window", "MapPartitions"):
        assert operator not in text, operator


@with_tables
@pytest.mark.parametrize(
    ("name", "scans"),
    [
        ("period_comparison", 1),
        ("category_breakdown", 1),
        ("category_view", 1),
        ("period_share", 1),
        ("year_range", 1),
        ("customer_kpis", 1),
        ("executive_insights", 2),
        ("olap_insights", 2),
        ("total_kpis", 1),
        ("olap_pivot", 1),
        ("olap_calendar_rollup", 1),
        ("quality_report", 2),
    ],
)
def test_number_of_fact_scans(spark, name, scans):
    text = final_plan(on_order_tables(QUERIES[name])(spark, FOLDER))
    assert text.count("FileScan parquet [l_") == scans, text


@with_tables
@pytest.mark.parametrize(
    "name",
    [
        "top_products_units",
        "top_products_revenue",
        "top_customers",
        "top_customers_period",
        "recent_sales",
        "sales_report",
        "urgent_stock",
        "best_category",
    ],
)
def test_top_lists_are_not_fully_sorted(spark, name):
    text = plan(on_order_tables(QUERIES[name])(spark, FOLDER))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


@with_tables
def test_filters_and_columns_reach_the_scans(spark):
    text = plan(on_order_tables(QUERIES["category_breakdown"])(spark, FOLDER))
    orders = next(x for x in text.split("\n") if "FileScan parquet [o_" in x)
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in orders
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in orders
    text = plan(on_order_tables(QUERIES["restock_plan_target"])(spark, FOLDER))
    assert "EqualTo(p_type,SMALL)" in text


def test_stock_bands_reach_the_scan(spark, tmp_path):
    star(spark, products=[product(1)]).products.write.parquet(str(tmp_path / "p"))
    stored = Star(None, spark.read.parquet(str(tmp_path / "p")), None)
    text = plan(inventory.inventory(stored, InventoryFilter(band=StockBand.ATTENTION)))
    assert "PushedFilters: [Or(IsNull(stock),LessThanOrEqual(stock,10))]" in text
    assert "PushedFilters: [Or(IsNull(stock),LessThanOrEqual(stock,10))]" in plan(
        inventory.restock_plan(stored)
    )


def test_broadcast_decision_follows_the_threshold(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "d"))
    dim = spark.read.parquet(str(tmp_path / "d"))
    for threshold, expected in (("10m", True), ("1GB", True), ("100", False), ("1k", False), ("-1", False)):
        with settings(spark, spark__sql__autoBroadcastJoinThreshold=threshold):
            assert fits_broadcast(dim) is expected, threshold


ROWS = 60_000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of all sales is one product, a third one customer; stored, so that sizes are known."""
    path = str(tmp_path_factory.mktemp("skewed"))
    spark.range(ROWS).selectExpr(
        "id AS sale_id",
        "date_add(DATE'1997-01-01', cast(id % 300 AS int)) AS sale_date",
        "CASE WHEN id % 3 = 1 THEN 1L ELSE id % 997 END AS customer_id",
        "CASE WHEN id % 3 = 0 THEN 1L ELSE id % 1009 END AS product_id",
        "cast(id % 7 + 1 AS int) AS quantity",
        "cast(id % 1000 / 100 AS decimal(12,2)) AS total_amount",
    ).repartition(8).write.parquet(path + "/sales")
    dims = star(
        spark,
        [],
        [product(i, f"p{i % 500}", f"c{i % 5}") for i in range(1000)],
        [customer(i, f"n{i % 400}") for i in range(990)],
    )
    dims.products.write.parquet(path + "/products")
    dims.customers.write.parquet(path + "/customers")
    return Star(*[spark.read.parquet(f"{path}/{t}") for t in ("sales", "products", "customers")])


def _lines():
    """The skewed sales in plain Python."""
    for i in range(ROWS):
        yield (
            i,
            1 if i % 3 == 1 else i % 997,
            1 if i % 3 == 0 else i % 1009,
            i % 7 + 1,
            Decimal(i % 1000) / 100,
        )


def test_hot_product_is_folded_before_the_join(spark, skewed):
    expected = Counter()
    for _, _, product_id, quantity, _ in _lines():
        if product_id < 1000:
            expected[f"p{product_id % 500}"] += quantity
    with no_broadcast(spark):
        df = products.units_by_product(skewed)
        assert dict(rows(df)) == expected
        text = final_plan(df)
        join = text.index("SortMergeJoin")
        assert "partial_sum(quantity" in text[join:], "the fact must be aggregated below the join"


def test_hot_customer_is_folded_before_the_join(spark, skewed):
    spent = Counter()
    for _, customer_id, _, _, amount in _lines():
        if customer_id < 990:
            spent[f"n{customer_id % 400}"] += amount
    ranked = sorted(spent.items(), key=lambda kv: (-kv[1], kv[0]))
    with no_broadcast(spark):
        df = customers.top_customers(skewed)
        assert rows(df) == [(k, float(v)) for k, v in ranked[:10]]
        text = final_plan(df)
        below = text[text.index("SortMergeJoin") :]
        assert re.search(r"HashAggregate\(keys=\[customer_id#\d+L\], functions=\[partial_sum\(", below)
        summary = {r[0]: r[2] for r in rows(customers.customer_summary(skewed))}
        assert summary == {k: float(v) for k, v in spent.items()}


def test_adaptive_execution_splits_the_hot_product_of_distinct_counts(spark, skewed):
    known = [line for line in _lines() if line[2] < 1000]
    with no_broadcast(
        spark,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="50k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50k",
        spark__sql__shuffle__partitions="40",
    ):
        df = kpis.period_kpis(skewed, SalesFilter())
        got = one(df)
        assert "skew=true" in final_plan(df)
    assert got["orders"] == len(known)
    assert got["active_customers"] == len({line[1] for line in known})
    assert got["revenue"] == float(sum(line[4] for line in known))


def test_adaptive_execution_splits_the_hot_product_of_price_checks(spark, skewed):
    amounts = (F.col("sale_id") % 100_000 / 100).cast("decimal(12,2)")  # amounts that hardly repeat
    distinct = Star(skewed.sales.withColumn("total_amount", amounts), skewed.products, skewed.customers)
    unknown = sum(line[2] >= 1000 for line in _lines())
    with no_broadcast(
        spark,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="50k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50k",
        spark__sql__shuffle__partitions="40",
    ):
        df = quality.product_mismatches(distinct)
        assert one(df)["unknown_product"] == unknown
        text = final_plan(df)
    assert "skew=true" in text
    assert text.count("hashpartitioning(product_id") == 2  # lines and prices, once each


@pytest.fixture(scope="module")
def hot_order(spark, tmp_path_factory):
    """Order tables in which one order has a third of all lines."""
    path = str(tmp_path_factory.mktemp("hot_order"))
    spark.range(ROWS).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7L ELSE id % 5003 END AS l_orderkey",
        "id % 50 AS l_partkey",
        "cast(id % 9 + 1 AS double) AS l_quantity",
        "id % 1000 / 4D AS l_extendedprice",
    ).repartition(8).write.parquet(path + "/lineitem.parquet")
    spark.range(5003).selectExpr(
        "id AS o_orderkey",
        "id % 80 AS o_custkey",
        "TIMESTAMP_NTZ'1997-01-01 10:00:00' + make_dt_interval(cast(id % 300 AS int)) AS o_orderdate",
    ).write.parquet(path + "/orders.parquet")
    spark.range(50).selectExpr(
        "id AS p_partkey",
        "concat('p', id) AS p_name",
        "concat('t', id % 3) AS p_type",
        "cast(id AS int) AS p_size",
        "cast(id AS double) AS p_retailprice",
    ).write.parquet(path + "/part.parquet")
    spark.range(80).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(
        path + "/customer.parquet"
    )
    return load_order_tables(spark, path)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        (lambda s: kpis.total_kpis(s).select("total_orders"), [(ROWS,)]),
        (lambda s: trends.revenue_by_year(s).select("yr"), [(1997,)]),
        (lambda s: products.best_category(s).select("category"), [("t1",)]),
        (lambda s: quality.duplicate_keys(s, "sales"), [(5003,)]),
        (lambda s: kpis.period_kpis(s, YEAR).select("orders"), [(5003,)]),
        (lambda s: customers.customer_kpis(s).select("repeat_customers"), [(80,)]),
    ],
)
def test_hot_order_is_split_where_lines_meet_orders(spark, hot_order, query, expected):
    with no_broadcast(
        spark,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4k",
        spark__sql__shuffle__partitions="40",
    ):
        df = query(hot_order)
        assert rows(df) == expected
        assert "skew=true" in final_plan(df)


def test_small_dimensions_are_joined_without_shuffling_the_fact(spark, skewed):
    df = products.category_revenue(skewed)
    text = plan(df)
    assert "BroadcastHashJoin" in text
    assert "hashpartitioning(product_id" not in text
    assert "hashpartitioning(category" in text


@pytest.mark.parametrize(
    "query",
    [
        lambda s: products.category_breakdown(s, YEAR),
        lambda s: trends.revenue_trend(s, YEAR),
        lambda s: olap.pivot(s),
        lambda s: olap.dice(s),
        lambda s: customers.top_customers_in_period(s, YEAR),
        lambda s: customers.active_customer_rating(s, YEAR),
        lambda s: kpis.period_comparison(s, YEAR),
        lambda s: insights.executive_insights(s, YEAR),
        lambda s: insights.olap_insights(s),
    ],
)
def test_both_join_plans_agree_on_skewed_data(spark, skewed, query):
    broadcast = rows(query(skewed))
    assert broadcast
    with no_broadcast(spark):
        assert rows(query(skewed)) == broadcast
