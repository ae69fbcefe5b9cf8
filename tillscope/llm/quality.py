"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is a sparse unit vector of hashed word n-gram counts (square roots), its score the logistic function of
a dot product. Labelled rows are dealt over shards; each shard runs FTRL-proximal updates over its rows in a
fixed order, and the shards' weights are averaged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.shared import in_fold, ship, table, worker_cache

#: Words, and runs of other visible characters as words of their own.
TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
#: The coordinate that every text has.
BIAS = 1 << BITS
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Hash of each word met; forgets all beyond a bound, and keeps no long word, such as a text without blanks."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) > 500_000:
                self.clear()
            self[word] = value
        return value


def hashes() -> Hashes:
    return worker_cache(("hashes",), Hashes)


def features(text: str | None, grams: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, values) of a text: n-grams of 1 to `grams` words, and the bias.

    An n-gram of one repeated word has the same coordinate whatever the word, so that repetition shows.
    """
    tokens = TOKEN.findall(text or "")
    h = np.fromiter(map(hashes().__getitem__, tokens), np.uint64, len(tokens))
    found, gram, same = [h], h, np.ones(len(h), bool)
    for n in range(2, grams + 1):
        if len(h) < n:
            break
        after = h[n - 1 :]
        same = same[:-1] & (after == h[n - 2 : -1])
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * MIX + after
        found.append(np.where(same, np.uint64(n), gram))
    every = np.concatenate(found) * MIX >> np.uint64(64 - BITS)
    at, count = np.unique(every.astype(np.int64), return_counts=True)
    value = np.sqrt(count)
    value /= max(1e-9, float(np.sqrt(value @ value)))
    return np.append(at, BIAS), np.append(value, 1.0)


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35.0, 35.0))))


class Ftrl:
    """FTRL-proximal for logistic loss, one learning rate per coordinate."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(w @ value) - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def training_sample(labels: DataFrame, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` labelled rows outside the held-out fold, chosen by hash of the id.

    Rows without id or label are left out; an id that is labelled twice has the mean, rounded.
    """
    each = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("label")).dropna()
    once = each.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return once.where(~in_fold(F.col("doc_id"), folds, held)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, per_shard: int = 5_000, passes: int = 3, folds: int = 3, held: int = 1) -> np.ndarray:
    """Weights learnt from whole texts of at most `most` labelled rows; all zero where there are none.

    `most` is the bound of the training sample, `per_shard` that of a shard. Labels are taken only from
    documents whose crc32(doc_id as text) mod `folds` is not `held`. Rows that repeat a labelled id are learnt each. Each text is
    sent once for each pass, so that a task holds one text at a time, however long.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = training_sample(labels, folds, held, most)
    count = sample.count()
    shards = max(1, -(-count // per_shard))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most `most` rows
    order = F.xxhash64("doc_id", F.lit(1))
    rows = texts.select(
        F.pmod(order, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"), order.alias("order"), "text", "label"
    )

    def learn(batches):
        models: dict[int, Ftrl] = {}
        for batch in batches:
            for shard, text, label in zip(batch.column("shard").to_pylist(), batch.column("text"), batch.column("label").to_pylist(), strict=True):
                models.setdefault(shard, Ftrl()).learn(*features(text.as_py()), label)
        for model in models.values():
            w = model.weights()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["at", "w"])

    # A task for each shard; hashes of so few numbers would leave some tasks with two.
    dealt = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "pass", "order", F.xxhash64("text"))
    sums = dealt.mapInArrow(learn, "at BIGINT, w DOUBLE").groupBy("at").agg(F.sum("w").alias("w")).toArrow()  # at most BIAS + 1 rows
    weights = np.zeros(BIAS + 1)
    weights[sums.column("at").to_numpy()] = sums.column("w").to_numpy() / shards
    return weights


def score(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, ..., score, predicted) of each row; `keep` names further columns to carry along.

    Null and empty texts get the score of the bias. Only the text is an input.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(weights)  # BIAS + 1 numbers
    carried = ["doc_id", *(keep or [])]
    out = docs.select(*carried, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def scored(batches):
        w = model.value
        for batch in batches:
            found = []
            for text in batch.column("text_"):
                at, value = features(text.as_py())
                found.append(logistic(w[at] @ value))
            p = np.array(found, float)
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*carried, "score", "predicted"])

    return docs.select(*carried, F.col("text").alias("text_")).mapInArrow(scored, out)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **training) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs`, learnt from its labelled rows.

    Null texts count as empty. Rows that repeat an id are scored each; for a null id held_out is false.
    Without labels every score is 0.5. No documents give no rows. Only doc_id, text and quality are read. Rows that
    repeat id and text get equal scores; very long texts are read whole.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score(rows, train(docs, labels, folds=folds, held=held, **training))
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier accepts (a score of 0.5 or more)."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return score(rows, train(docs, labels, **training), ["row"]).where("predicted = 1").select("row.*")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
