"""Sums of the fact by day and product, stored by year, in place of the fact for measures that add up.

A day's lines of a product become one row: revenue, units, lines, amounts and rows. Trends, category and product
revenue, the OLAP cube, totals and the values that fill the filters then read this table, whose size is bounded by days
times products whatever the number of lines. Distinct counts, customers and single lines still read the fact.

Products that change their category need no update, since dimensions are joined when a query runs. A year whose lines
change is replaced as a whole by `replace_years`; `stale_years` names the years whose number of lines has changed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.model import MONEY_SUM, SALE_YEAR, Star, Table
from tillscope.operators.facts import ADDITIVE, ROWS, Kind, rows
from tillscope.sources.scratch import working_folder

GRAIN = ("sale_date", "product_id")
SUMS = ", ".join(f"{m.stored} {MONEY_SUM if m.kind is Kind.MONEY else 'bigint'}" for m in ADDITIVE)
DAILY = f"sale_date date, product_id bigint, {SUMS}, {SALE_YEAR} int"


class DailyStar(Star):
    """A star with stored sums beside its fact."""

    def __init__(self, star: Star, daily: DataFrame):
        self.star, self.daily = star, daily

    def table(self, name: str) -> DataFrame:
        return self.star.table(name)

    def parts(self, key: str) -> list[DataFrame]:
        return self.star.parts(key)

    @property
    def summed(self) -> DataFrame:
        return self.daily

    def summed_parts(self, key: str) -> list[DataFrame]:
        return [self.daily] if key in GRAIN else self.parts(key)

    def replaced(self, **tables: Table) -> Star:
        """The sums are kept for other dimensions, and given up for another fact."""
        changed = self.star.replaced(**tables)
        return changed if "sales" in tables else DailyStar(changed, self.daily)


def daily_sums(sales: DataFrame) -> DataFrame:
    """One row per day and product, null ones too; every task folds its lines before they are shuffled."""
    folded = sales.groupBy(*GRAIN).agg(*[m.first_step(sales).alias(m.stored) for m in ADDITIVE])
    return folded.withColumn(SALE_YEAR, F.year("sale_date"))


def _write(sums: DataFrame, path: str, mode: str) -> None:
    """By year, a big one over several tasks; files sorted by date, so that their statistics prune date ranges."""
    dealt = sums.hint("rebalance", F.col(SALE_YEAR)).sortWithinPartitions(SALE_YEAR, *GRAIN)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(SALE_YEAR).parquet(path)


def write_daily(star: Star, path: str) -> None:
    """Write the sums of a star's whole fact to a new folder."""
    _write(daily_sums(star.sales), path, "errorifexists")


def _year_of(sales: DataFrame) -> Column:
    return F.col(SALE_YEAR).cast("int") if SALE_YEAR in sales.columns else F.year("sale_date")


def replace_years(star: Star, path: str, years: Iterable[int | None]) -> None:
    """Compute the sums of whole years anew (None: lines without a date) and put them in place of the stored ones.

    Only lines of these years are read where the fact is stored by year. A year without lines is removed. Years that
    are written take effect together at the end of the write; queries that read them in that moment may fail. A replacement that
    failed can be repeated.
    """
    wanted = list(dict.fromkeys(years))
    if not wanted:
        return
    year = _year_of(star.sales)
    numbers = [y for y in wanted if y is not None]
    chosen = year.isin(numbers) if None not in wanted else year.isin(numbers) | year.isNull()
    lines = star.sales.where(chosen)
    _write(daily_sums(lines), path, "overwrite")
    held = {r.yr for r in lines.select(year.alias("yr")).distinct().collect()}  # at most the given years
    spark = star.sales.sparkSession
    for gone in set(wanted) - held:
        name = "__HIVE_DEFAULT_PARTITION__" if gone is None else gone
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SALE_YEAR}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def load_daily(spark: SparkSession, star: Star, path: str) -> DailyStar:
    """The star with the sums stored under `path`, which have to be those of its fact."""
    return DailyStar(star, spark.read.schema(DAILY).parquet(path))


def stale_years(star: DailyStar) -> DataFrame:
    """Years (null: without a date) in which the fact holds another number of lines than the sums stand for, with both.

    Of a fact stored by year no column is read. A year whose lines changed while their number did not, is not found.
    """
    sales, daily = star.sales, star.daily
    held = sales.groupBy(_year_of(sales).alias("yr")).agg(rows().alias("held"))
    known = daily.groupBy(F.col(SALE_YEAR).alias("known_yr")).agg(F.sum(ROWS.stored).alias("stored"))
    both = held.join(known, F.col("yr").eqNullSafe(F.col("known_yr")), "full_outer")
    found, stored = (F.coalesce(F.col(c), F.lit(0)) for c in ("held", "stored"))
    return (
        both.select(F.coalesce("yr", "known_yr").alias("yr"), found.alias("held"), stored.alias("stored"))
        .where(F.col("held") != F.col("stored"))
        .orderBy(F.asc_nulls_last("yr"))
    )


def with_daily(star: Star) -> DailyStar:
    """The star with its sums written to a new working folder."""
    spark = star.products.sparkSession
    path = working_folder(spark, "daily")
    write_daily(star, path)
    return load_daily(spark, star, path)
