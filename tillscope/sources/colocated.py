"""A star stored for joins with large dimensions: facts and dimensions lie in the same buckets of their join key.

Layout under a folder:

    products, customers                        bucketed and sorted by their id
    sales_by_product, sales_by_customer        bucketed and sorted by the join key; the second on request
    sales_by_product_hot, ...                  the lines of hot keys, in files of any size
    layout                                     one row: buckets, and the copies of the fact

A bucket is read by one task, so a key with more lines than an average bucket is hot. Its lines are stored apart, where
any number of tasks read them and fold them before they meet their dimension.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.model import CONTRACTS, Star
from tillscope.operators.facts import rows
from tillscope.sources.scratch import working_folder

KEYS = {"sales_by_product": "product_id", "sales_by_customer": "customer_id"}
LAYOUT = "buckets int, by_customer boolean"


class ColocatedStar(Star):
    """A star whose fact can be had in parts that lie by a join key: the bucketed lines and those of hot keys."""

    def __init__(self, by_key: dict[str, list[DataFrame]], products: DataFrame, customers: DataFrame, names: list[str]):
        cold, hot = by_key["product_id"]
        super().__init__(cold.unionByName(hot), products, customers)
        self.by_key, self.names = by_key, names

    def parts(self, key: str) -> list[DataFrame]:
        return self.by_key.get(key) or super().parts(key)

    def forget(self) -> None:
        """Drop the catalog entries of the tables; their files stay."""
        for name in self.names:
            self.products.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _bucketed(spark: SparkSession, path: str, table: str, key: str, buckets: int) -> str:
    """The catalog name of a bucketed table over the files of `path`."""
    name = f"colocated_{uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CONTRACTS[table])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _write(df: DataFrame, path: str, table: str, key: str, buckets: int) -> None:
    name = _bucketed(df.sparkSession, path, table, key, buckets)
    df.select(*CONTRACTS[table].fieldNames()).repartition(buckets, key).write.insertInto(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def hot_keys(sales: DataFrame, key: str, buckets: int) -> DataFrame:
    """Values of `key`, null too, with more lines than an average bucket; so there are fewer than `buckets`."""
    counts = sales.groupBy(key).agg(rows().alias("n"))
    average = sales.agg(rows() / buckets).scalar()
    return counts.where(F.col("n") > average).select(F.col(key).alias("hot"))


def write_colocated(star: Star, path: str, buckets: int = 64, by_customer: bool = False) -> None:
    """Write a star into `buckets` buckets below a new folder; with `by_customer` a second copy of the fact by customer.

    Choose buckets of about 128 MB to 1 GB. Lines lie by key, not by date: for date ranges of a few days a star
    that is stored by year reads less.
    """
    spark = star.products.sparkSession
    _write(star.products, f"{path}/products", "products", "product_id", buckets)
    _write(star.customers, f"{path}/customers", "customers", "customer_id", buckets)
    for copy, key in KEYS.items():
        if key == "customer_id" and not by_customer:
            continue
        hot = F.broadcast(hot_keys(star.sales, key, buckets))  # fewer rows than buckets
        is_hot = F.col(key).eqNullSafe(F.col("hot"))
        _write(star.sales.join(hot, is_hot, "left_anti"), f"{path}/{copy}", "sales", key, buckets)
        star.sales.join(hot, is_hot, "left_semi").select(*CONTRACTS["sales"].fieldNames()).write.parquet(f"{path}/{copy}_hot")
    layout = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(by_customer).alias("by_customer"))
    layout.coalesce(1).write.json(f"{path}/layout")  # written last: without it there is no star


def load_colocated(spark: SparkSession, path: str) -> ColocatedStar:
    """Open a star that `write_colocated` wrote. Its tables get names in the session's catalog until `forget`."""
    layout = spark.read.schema(LAYOUT).json(f"{path}/layout").first()
    names: list[str] = []

    def opened(folder: str, table: str, key: str) -> DataFrame:
        names.append(_bucketed(spark, f"{path}/{folder}", table, key, layout.buckets))
        return spark.table(names[-1])

    by_key = {
        key: [opened(copy, "sales", key), spark.read.schema(CONTRACTS["sales"]).parquet(f"{path}/{copy}_hot")]
        for copy, key in KEYS.items()
        if key == "product_id" or layout.by_customer
    }
    return ColocatedStar(by_key, opened("products", "products", "product_id"), opened("customers", "customers", "customer_id"), names)


def colocated(star: Star, buckets: int = 16) -> ColocatedStar:
    """The star written to a new working folder, with both copies of the fact, and opened again."""
    spark = star.products.sparkSession
    path = working_folder(spark, "colocated")
    write_colocated(star, path, buckets, by_customer=True)
    return load_colocated(spark, path)
