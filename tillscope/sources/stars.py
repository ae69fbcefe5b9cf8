"""Readers of the star schema: stored files and relational databases."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from tillscope.model import CONTRACTS, Star


@dataclass(frozen=True)
class KeyRange:
    """How to cut a JDBC table into parallel reads: a numeric or date column and its value range.

    The bounds only place the cuts; rows outside them are read as well, by the first and last part.
    """

    column: str
    lower: str
    upper: str
    parts: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.parts),
        }


def _parquet(reader: DataFrameReader, path: str) -> DataFrame:
    return reader.parquet(path)


def _csv(reader: DataFrameReader, path: str) -> DataFrame:
    """Strict: a header that differs from the contract or a value that does not parse is an error."""
    return (
        reader.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .csv(path)
    )


FILE_READERS = {"parquet": _parquet, "csv": _csv}


def load_star(
    spark: SparkSession, path: str, fmt: str = "parquet", as_stored: bool = False
) -> Star:
    """Read <path>/sales, <path>/products and <path>/customers with the contract's types.

    With `as_stored`, Parquet files keep their own columns and types, to be checked by
    `schema_report`.
    """
    if fmt not in FILE_READERS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {sorted(FILE_READERS)}")
    if as_stored and fmt != "parquet":
        raise ValueError("only Parquet files know their own types")
    read = FILE_READERS[fmt]
    tables = {}
    for name, contract in CONTRACTS.items():
        reader = spark.read if as_stored else spark.read.schema(contract)
        tables[name] = read(reader, f"{path}/{name}")
    return Star(**tables)


def jdbc_options(
    table: str,
    url: str,
    connection: Mapping[str, str] | None = None,
    key_range: KeyRange | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for one table: contract types, server-side cursors, parallel key ranges."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CONTRACTS[table])
    options = {
        "url": url,
        "dbtable": table,
        "customSchema": types,
        "fetchsize": str(fetch_size),
        **(connection or {}),
    }
    return {**options, **key_range.options()} if key_range else options


def load_star_jdbc(
    spark: SparkSession,
    url: str,
    connection: Mapping[str, str] | None = None,
    key_ranges: Mapping[str, KeyRange] | None = None,
    small: Collection[str] = (),
) -> Star:
    """Read the three tables from a database. Filters and column picks are pushed into its queries.

    A table without a key range is read by a single task. So each table needs one, except a dimension
    that the caller names in `small`.
    """
    key_ranges = key_ranges or {}
    for name in ("sales", "products", "customers"):
        if name not in key_ranges and (name == "sales" or name not in small):
            raise ValueError(f"{name} needs a KeyRange, or one task would read the whole table")
    return Star(
        **{
            name: spark.read.format("jdbc")
            .options(**jdbc_options(name, url, connection, key_ranges.get(name)))
            .load()
            for name in CONTRACTS
        }
    )
