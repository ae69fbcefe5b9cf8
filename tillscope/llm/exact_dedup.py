"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

New data is joined to the index by a sort-merge anti-join; digests that are new are appended. The index is
an ordinary bucketed table, so both sides of later joins meet without a shuffle of the index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.shared import scratch, stored, table


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class DigestIndex:
    """Digests seen so far, with the row that stays for each.

    `location` is a folder that all executors share; an index written there by an earlier session is opened
    again. `buckets` is fixed when the index is made: about one bucket per 128 MB of expected digests.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, keep_row BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 48):
        self.spark = spark
        self.location = location or scratch(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append the texts of `docs` that the index does not hold; one row per row of `docs`.

        Result: doc_id, keep_id (the document that stays), group_size (rows of this batch with the text),
        kept, text_sha256. A row is kept if its text is new and it is the batch's first by doc_id. A null id
        sorts first. Of repeated rows (same id and text) exactly one is kept. Null text counts as empty, and
        empty texts are copies of each other. An empty batch gives no rows. Only doc_id and text are read.
        """
        batch = uuid.uuid4().hex
        digests = stored(
            docs.select(
                F.col("doc_id").cast("bigint").alias("doc_id"),
                F.monotonically_increasing_id().alias("row"),
                F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
            ),
            "digests",
        )
        # Partial aggregation folds a hot text to one row per task before anything moves.
        groups = stored(
            digests.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("group_size")),
            "groups",
        )
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.name)
        )
        known = self.rows().join(groups.select("digest", "group_size"), "digest")
        mine = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
        # One index row per digest: a text with a third of all rows is hot on the left side only, where
        # adaptive execution splits it.
        return digests.join(known, "digest").select(
            "doc_id", "keep_id", "group_size", mine.alias("kept"), F.col("digest").alias("text_sha256")
        )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against a new index: which row of equal texts stays."""
    return DigestIndex(spark).add(table(spark, folder, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
