"""Data-quality jobs: what a database would enforce with constraints is counted here."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillscope.model import CONTRACTS, PRIMARY_KEYS, SALE_YEAR, Star
from tillscope.operators.facts import fits_broadcast, rows, together
from tillscope.sources.scratch import working_folder


class QualityError(ValueError):
    """Raised by `assert_quality`; lists the failed checks."""


def row_counts(star: Star) -> DataFrame:
    """One row per table: its number of rows."""
    counts = [
        star.table(name).agg(rows().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in CONTRACTS
    ]
    return reduce(DataFrame.unionByName, counts)


def _as_rows(one_row: DataFrame, table: str) -> DataFrame:
    """A one-row frame of counters as (check, table_name, violations) rows."""
    counters = one_row.columns
    return one_row.unpivot([], counters, "check", "violations").select(
        "check", F.lit(table).alias("table_name"), "violations"
    )


def _rules(table: str) -> list[tuple[str, Column]]:
    """Name and predicate of the table's domain rules and of the null test of every contract column."""
    rules = {
        "products": {"negative_stock": F.col("stock") < 0},
        "customers": {"rate_out_of_range": (F.col("rate") < 1) | (F.col("rate") > 5)},
        "sales": {
            "negative_amount": F.col("total_amount") < 0,
            "quantity_not_positive": F.col("quantity") <= 0,
        },
    }[table]
    nulls = {f"null_{c}": F.col(c).isNull() for c in CONTRACTS[table].fieldNames()}
    return [*rules.items(), *nulls.items()]


def _counters(table: str) -> list[Column]:
    """How many rows break each rule; all in one aggregate."""
    return [F.count_if(rule).alias(name) for name, rule in _rules(table)]


def duplicate_keys(star: Star, table: str) -> DataFrame:
    """One row: how many key values of a table occur more than once. Nulls are reported elsewhere.

    The key is grouped as a struct, which no earlier partitioning fits. Were it grouped as it is, a
    table that comes out of a join on this key would be counted inside the join's own partitions, and
    adaptive execution could then not split the partition of a hot key.
    """
    key = PRIMARY_KEYS[table]
    return (
        star.table(table)
        .where(F.col(key).isNotNull())
        .groupBy(F.struct(key).alias("key"))
        .agg(rows().alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("duplicate_key"))
    )


def orphan_customers(star: Star) -> DataFrame:
    """One row: sales lines whose customer is unknown (or null)."""
    known = star.customers.select("customer_id")
    parts = star.parts("customer_id")
    if fits_broadcast(known):
        lines = [part.select("customer_id", F.lit(1).alias("n")) for part in parts]
    else:
        lines = [part.groupBy("customer_id").agg(rows().alias("n")) for part in parts]
    missing = together([part.join(known, "customer_id", "left_anti") for part in lines])
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unknown_customer"))


def product_mismatches(star: Star) -> DataFrame:
    """One row: sales lines with an unknown (or null) product, and lines where amount is not
    quantity x price.

    Lines meet prices one by one, since amounts hardly repeat. With a large product table that is one
    shuffle of the fact, and adaptive execution can split a hot product on the fact's side.
    """
    prices = star.products.select("product_id", "price", F.lit(True).alias("known"))
    lines = [part.select("product_id", "quantity", "total_amount") for part in star.parts("product_id")]
    return together([part.join(prices, "product_id", "left") for part in lines]).agg(
        F.count_if(F.col("known").isNull()).alias("unknown_product"),
        F.count_if(F.col("total_amount") != F.col("quantity") * F.col("price")).alias(
            "amount_not_quantity_x_price"
        ),
    )


def _one_pass(star: Star, counters: list[tuple[str, Column]]) -> DataFrame:
    """One row: both reference checks of sales over small dimensions, and how many lines break each rule of `counters`.

    A line meets each price row of its product, as in `product_mismatches`. Only the first of them counts the
    line for what is not about prices.
    """
    customers = star.customers.select("customer_id", F.lit(True).alias("known_customer")).distinct()
    prices = star.products.groupBy("product_id").agg(F.collect_list("price").alias("prices"))
    prices = prices.select("product_id", F.lit(True).alias("known_product"), F.posexplode_outer("prices").alias("place", "price"))
    lines = star.sales.join(F.broadcast(customers), "customer_id", "left")
    lines = lines.join(F.broadcast(prices), "product_id", "left")
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    return lines.agg(
        *(F.count_if(first & rule).alias(name) for name, rule in counters),
        F.count_if(first & F.col("known_customer").isNull()).alias("unknown_customer"),
        F.count_if(F.col("known_product").isNull()).alias("unknown_product"),
        F.count_if(F.col("total_amount") != F.col("quantity") * F.col("price")).alias(
            "amount_not_quantity_x_price"
        ),
    )


def watched(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """`df` with an observation of its row count and of all row-wise rules, filled by the job that writes it.

    What is observed has to run in the stage that writes (above the last shuffle): there each task counts
    once, also where an executor is lost and a task runs again.
    """
    seen = Observation(f"{table}-{uuid4().hex}")
    key = F.col(PRIMARY_KEYS[table])
    keys = [F.min(key).alias("key_min"), F.max(key).alias("key_max")]
    return df.observe(seen, rows().alias("row_count"), *keys, *_counters(table)), seen


#: Values that a key's range may have for each row, so that bitmaps of it are smaller than the keys themselves.
DENSE = 64


def are_dense(counted: Mapping[str, int]) -> bool:
    """Whether the keys of a table that `watched` has seen lie close together."""
    low, high = counted["key_min"], counted["key_max"]
    return low is not None and high - low < DENSE * counted["row_count"]


def suspect_stretches(df: DataFrame, key: str) -> DataFrame:
    """(stretch): runs of 32,768 key values in which some value occurs twice.

    Each task sets a bit for each key, and what it sends is a bitmap and a count for each stretch it has met: a
    64th of its keys where they are dense. A stretch with as many rows as bits has no value twice.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(key).alias("stretch")).agg(
        rows().alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(key))).alias("bits")
    )
    return counts.where(F.col("n") > F.col("bits")).select("stretch")


def count_duplicates(df: DataFrame, key: str) -> int:
    """How many values of a dense integer key occur more than once; equal to `duplicate_keys`, and runs at once.

    Only keys of suspect stretches are counted one by one. The stretches are written out, so that Catalyst knows their
    size before it chooses how the keys meet them; there are none in a table without duplicates.
    """
    spark = df.sparkSession
    path = working_folder(spark, "stretches")
    suspect_stretches(df, key).write.parquet(path)
    stretches = spark.read.schema("stretch bigint").parquet(path)
    if stretches.isEmpty():
        return 0
    keyed = df.where(F.col(key).isNotNull()).select(key, F.bitmap_bucket_number(key).alias("stretch"))
    counts = keyed.join(stretches, "stretch", "left_semi").groupBy(F.struct(key).alias("key")).agg(rows().alias("n"))
    return counts.where(F.col("n") > 1).count()


def quality_report(star: Star, counted: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """One row per check with its number of violations; every one should be 0.

    Per table one aggregate holds all row-wise rules, without a shuffle. With small dimensions it also
    holds the reference checks, so that the fact is read twice: there, and for key uniqueness. With
    large ones each reference check is a join of its own.

    `counted` has the row-wise counters of tables that `watched` has seen on their way into files, and
    duplicate_key where `count_duplicates` has counted it. They are not counted again.
    """
    counted = counted or {}
    spark = star.products.sparkSession
    parts = []
    for table in CONTRACTS:
        if "duplicate_key" in counted.get(table, {}):
            known = spark.range(1).select(F.lit(counted[table]["duplicate_key"]).cast("bigint").alias("duplicate_key"))
            parts.append(_as_rows(known, table))
        else:
            parts.append(_as_rows(duplicate_keys(star, table), table))
        if table in counted:
            seen = [F.lit(counted[table][name]).cast("bigint").alias(name) for name, _ in _rules(table)]
            parts.append(_as_rows(spark.range(1).select(*seen), table))
        elif table != "sales":
            parts.append(_as_rows(star.table(table).agg(*_counters(table)), table))
    own = [] if "sales" in counted else _rules("sales")
    # The very columns that a broadcast would hold, of all rows.
    small = (star.customers.select("customer_id", F.lit(True)), star.products.select("product_id", "price", F.lit(0), F.lit(True)))
    if all(map(fits_broadcast, small)):
        parts.append(_as_rows(_one_pass(star, own), "sales"))
    else:
        if own:
            parts.append(_as_rows(star.sales.agg(*_counters("sales")), "sales"))
        parts.append(_as_rows(orphan_customers(star), "sales"))
        parts.append(_as_rows(product_mismatches(star), "sales"))
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "check")


def assert_quality(report: DataFrame, allowed: frozenset[str] = frozenset()) -> None:
    """Raise if any check outside `allowed` has violations. Fetches at most one row per check."""
    failed = [
        r for r in report.where(F.col("violations") > 0).collect() if r["check"] not in allowed
    ]
    if failed:
        found = ", ".join(f"{r['table_name']}.{r['check']}={r['violations']}" for r in failed)
        raise QualityError(f"quality checks failed: {found}")


def schema_report(spark: SparkSession, star: Star) -> DataFrame:
    """Deviations of the tables' column order, names and types from the contract; metadata only.

    Nullability is not compared: files never carry it, null counts are in `quality_report`.
    """
    deviations = []
    for table, contract in CONTRACTS.items():
        expected = [(f.name, f.dataType.simpleString()) for f in contract]
        actual = [
            (f.name, f.dataType.simpleString())
            for f in star.table(table).schema
            if f.name != SALE_YEAR
        ]
        for position in range(max(len(expected), len(actual))):
            want = expected[position] if position < len(expected) else None
            have = actual[position] if position < len(actual) else None
            if want != have:
                shown = [" ".join(c) if c else None for c in (want, have)]
                deviations.append((table, position, *shown))
    return spark.createDataFrame(
        deviations, "table_name string, position int, expected string, actual string"
    )
