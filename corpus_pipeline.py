"""From raw documents to packed sequences in five stages.

Each stage reads what the stage before it wrote. The first four return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.decontaminate import clean
from tillscope.llm.jaccard import one_of_each
from tillscope.llm.line_dedup import dedup_lines
from tillscope.llm.packing import pack
from tillscope.llm.quality import accepted
from tillscope.llm.shared import stored, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share; n_chars follows the text. A null text stays null."""
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text")).alias("text")
    kept = dedup_lines(docs).select("row", text)
    fields = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint").alias("n_chars")}
    return kept.select(*(fields.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can train no classifier and run no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the `documents` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
