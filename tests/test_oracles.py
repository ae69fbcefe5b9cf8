"""Every registered query against its SQL oracle, on the driver's tables."""

import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from tillscope.plans.oracles import ORACLES
from tillscope.plans.registry import QUERIES, on_order_tables

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("part", "customer", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no driver tables here")

SPARK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
#: Results without a given order, or with one that their SQL does not spell out.
UNORDERED = {
    "units_by_product", "olap_slice_all", "olap_slice_category", "row_counts", "stock_distribution", "stock_distribution_low",
}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def test_registry_and_oracles_have_the_same_keys():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    df = on_order_tables(QUERIES[name])(spark, FOLDER)
    result = oracle.execute(ORACLES[name])
    oracle_types = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: SPARK_TYPES[f.dataType.simpleString()] for f in df.schema} == oracle_types

    columns = sorted(df.columns)
    order = [c[0] for c in result.description]
    ours = [tuple(repr(row[c]) for c in columns) for row in df.collect()]
    theirs = [tuple(repr(row[order.index(c)]) for c in columns) for row in result.fetchall()]
    assert ours, "a registered query must return rows"
    if name not in UNORDERED:
        assert ours == theirs
    assert sorted(ours) == sorted(theirs)


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
