"""Full refresh of a stored star from CSV, atomic over all three tables.

Layout under the target folder:

    versions/<id>/{products,customers,sales}   one complete star per refresh; sales by year
    commits/                                   append-only log of the refreshes that count

A refresh writes a new version, checks it, and only then appends one row to the log. Readers follow
the log, so they see either the old star or the whole new one; a refresh that fails or loses its
cluster half way leaves an unlisted folder and changes nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.model import PRIMARY_KEYS, SALE_YEAR, Star
from tillscope.operators.quality import are_dense, assert_quality, count_duplicates, quality_report, watched
from tillscope.sources.scratch import working_folder
from tillscope.sources.stars import load_star

COMMITS = "version string, committed_at timestamp"


def _by_year(sales: DataFrame) -> DataFrame:
    """Rows gathered by year for writing. The rebalance hint lets adaptive execution split a year
    that is too big for one task and merge years that are small."""
    return sales.withColumn(SALE_YEAR, F.year("sale_date")).hint("rebalance", F.col(SALE_YEAR))


def write_star(star: Star, path: str) -> dict[str, dict[str, int]]:
    """Write a star as Parquet folders; sales partitioned by year, its files sorted by date, so that their
    statistics prune date ranges inside a year.

    Returns per table what the writing tasks counted on the way: its rows, and those that break each row-wise
    rule of the quality report.
    """
    seen = {}
    for table in ("products", "customers", "sales"):
        rows = star.table(table)
        rows, seen[table] = watched(_by_year(rows) if table == "sales" else rows, table)
        if table == "sales":
            rows = rows.sortWithinPartitions(SALE_YEAR, "sale_date")
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(SALE_YEAR) if table == "sales" else writer).parquet(f"{path}/{table}")
    return {table: dict(observation.get) for table, observation in seen.items()}


def ingest_star(
    spark: SparkSession, source: str, target: str, allowed: frozenset[str] = frozenset()
) -> Star:
    """Replace the star under `target` with the CSV tables under `source`.

    The CSV is parsed once. Row-wise checks run inside the write; the written Parquet is read only for key
    uniqueness, by bitmaps where keys are dense, and for references. Checks named in `allowed` may fail.
    """
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"
    path = f"{target}/versions/{version}"
    counted = write_star(load_star(spark, source, "csv"), path)
    written = load_star(spark, path)
    assert_quality(gate_report(written, counted), allowed)
    commit = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("committed_at")
    )
    commit.coalesce(1).write.mode("append").json(f"{target}/commits")
    return written


def gate_report(written: Star, counted: dict[str, dict[str, int]]) -> DataFrame:
    """The quality report of a star that `write_star` wrote and counted. Keys that lie close together, as the write has
    seen, are checked by bitmaps."""
    for table, seen in counted.items():
        if are_dense(seen):
            seen["duplicate_key"] = count_duplicates(written.table(table), PRIMARY_KEYS[table])
    return quality_report(written, counted)


def gated_write(star: Star, path: str | None = None) -> DataFrame:
    """Write a star to `path` (default: a new working folder) and report on it as a refresh does before it commits."""
    spark = star.products.sparkSession
    path = path or working_folder(spark, "star")
    counted = write_star(star, path)
    return gate_report(load_star(spark, path), counted)


def current_version(spark: SparkSession, target: str) -> str:
    """The version committed last. Version ids start with their time, so ties cannot arise."""
    try:
        log = spark.read.schema(COMMITS).json(f"{target}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no committed star under {target}") from error
    latest = log.agg(F.max(F.struct("committed_at", "version")).alias("latest"))
    version = latest.select("latest.version").first()[0]
    if version is None:
        raise ValueError(f"no committed star under {target}")
    return version


def expire_versions(
    spark: SparkSession, target: str, keep: int = 2, failed_after: timedelta = timedelta(days=7)
) -> list[str]:
    """Delete old versions below `target` and return their ids, oldest first.

    The newest `keep` committed versions stay, so the current one always does. A version that was never
    committed goes once it is older than `failed_after`, which has to exceed the longest refresh. Queries
    that still read an older version fail, so `keep` has to cover the running ones.
    """
    if keep < 1:
        raise ValueError("the current version cannot be deleted")
    current_version(spark, target)
    log = spark.read.schema(COMMITS).json(f"{target}/commits").distinct()
    committed = [r.version for r in log.orderBy("committed_at", "version").collect()]
    oldest_running = f"{datetime.now(timezone.utc) - failed_after:%Y%m%dT%H%M%S%f}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = sorted(status.getPath().getName() for status in files.listStatus(folder))
    expired = [
        v for v in held if v in committed[:-keep] or (v not in committed and v < oldest_running)
    ]
    for version in expired:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, version), True)
    return expired


def load_current_star(spark: SparkSession, target: str) -> Star:
    return load_star(spark, f"{target}/versions/{current_version(spark, target)}")
