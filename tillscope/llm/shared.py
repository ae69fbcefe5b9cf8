"""What the operators share: scratch tables, plain text normalisation, public tokenizers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources.scratch import working_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six characters of the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder path in the shared folder that the cluster names in spark.checkpoint.dir; see `working_folder`."""
    return working_folder(spark, label)


def stored(frame: DataFrame, label: str, *partitions: str) -> DataFrame:
    """`frame` written as Parquet to a new scratch folder and read back.

    It cuts the lineage so that lost executors cost no recomputation, spares work that several branches
    need, and gives Catalyst the true size for its choice of joins.
    """
    path = scratch(frame.sparkSession, label)
    frame.write.partitionBy(*partitions).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per session, wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_tillscope_shipped", False):
        package = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="tillscope-")) / "tillscope.zip", "w") as file:
            for source in sorted(package.rglob("*.py")):
                file.write(source, source.relative_to(package.parent))
        context.addPyFile(file.filename)
        context._tillscope_shipped = True


_CACHE: dict = {}


def worker_cache(key: tuple, make: Callable):
    """What this worker process keeps between tasks under `key`. A new key drops the one before.

    Workers live on through the stages of a pipeline; so the caches of different operators do not add up.
    """
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text of ASCII only takes the much faster `lower`."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A plain column would be inlined into lambdas by the optimizer, and computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, written as text, leaves the remainder `fold`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
