"""Token counts by an exact histogram of encoded lengths.

Documents are folded to one row per length. Suffix sums over the lengths then answer totals, quantiles and
truncated totals for every context limit without another look at the documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.encoding import encoded
from tillscope.llm.shared import ship, stored, table, tokenizer_path

#: Lengths are summed in blocks of so many, and the block totals once more, so that no task sees them all.
BLOCK = 4096


def token_lengths(docs: DataFrame, path: str, end: int | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each document's whole text; null text counts as empty."""

    def lengths(batches):
        ids, counts = [], []
        for doc_id, found in encoded(batches, path, end):
            ids.append(doc_id)
            counts.append(len(found) // 4)
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])
                ids, counts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lengths, "doc_id BIGINT, n_tokens BIGINT")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with what a context limit of that length means.

    n_tokens (the length), n_docs; docs_at_least and tokens_at_least (suffix sums over this length and
    longer ones); docs_up_to and share_up_to (the length's quantile); total_docs and total_tokens;
    truncated_tokens (what is left if each document is cut to this length). No documents give no rows.
    """
    counts = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    # A text has at most 2^31 bytes, so there are at most 2^31 / BLOCK block totals.
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(Window.partitionBy()).alias("total_docs"),
        F.sum("t").over(Window.partitionBy()).alias("total_tokens"),
    )
    here = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    docs = F.sum("n_docs").over(here) + F.col("later_docs")
    tokens = F.sum("tokens").over(here) + F.col("later_tokens")
    sums = rows.join(blocks, "block").select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "total_docs", "total_tokens")
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    shorter = F.col("total_tokens") - F.col("tokens_at_least")
    return sums.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        up_to.alias("docs_up_to"), (up_to / F.col("total_docs")).alias("share_up_to"), "total_docs", "total_tokens",
        (shorter + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row per context limit: docs_within, tokens_within, truncated_tokens; any limit, from the histogram."""
    length, docs = F.col("n_tokens"), F.col("n_docs")
    zero = F.lit(0).cast("bigint")
    answer = lambda limit: F.struct(
        F.lit(limit).alias("context"),
        F.coalesce(F.sum(F.when(length <= limit, docs)), zero).alias("docs_within"),
        F.coalesce(F.sum(F.when(length <= limit, docs * length)), zero).alias("tokens_within"),
        F.coalesce(F.sum(F.least(length, F.lit(limit)) * docs), zero).alias("truncated_tokens"),
    )
    return histogram.agg(F.array(*map(answer, limits)).alias("a")).select(F.inline("a"))


def length_at(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length within which at least `share` of the documents lie; null without documents."""
    return histogram.agg(F.min(F.when(F.col("share_up_to") >= share, F.col("n_tokens"))).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The histogram of all documents, without special tokens."""
    return length_histogram(token_lengths(table(spark, folder, "documents"), tokenizer_path()))
