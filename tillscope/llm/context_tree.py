"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

A text is its words in A-Z lower case, each followed by one space, and an end byte. Each byte is eight binary
decisions; for each decision the last 0 to `depth` bytes are contexts. Spark counts all byte grams of the
training texts. Krichevsky-Trofimov estimates of all depths are mixed with the weights that context-tree
weighting gives them on the training counts; the frozen mixture then gives each text its code length.

The whole tree is a table for each depth, made by a groupBy (weights, from the leaves) and a join (mixture,
from the root) on the parent context; the driver holds none of it. Frequent grams and words are looked up in
the tasks, all others joined; how many are looked up changes the time and not the scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.encoding import slices
from tillscope.llm.shared import in_fold, ship, stored, table

END = 10
#: Bytes that are turned into gram keys at a time.
STEP = 1 << 20


def prepared(texts: pa.Array, depth: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of texts with A-Z in lower case (as bytes) and how many each text has; the texts as bytes, each
    with `depth` end bytes before it, and where each begins there. These kernels know ASCII only."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))))
    words, n = split.flatten().cast(pa.binary()), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(split, " ")
    blank = pc.equal(joined, "")
    n[blank.to_numpy(zero_copy_only=False)] = 0
    data = pc.binary_join_element_wise(pa.scalar(chr(END) * depth), joined, pc.if_else(blank, chr(END), " " + chr(END)), "")
    begin = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset).astype(np.int64)
    return words.filter(pc.greater(pc.binary_length(words), 0)), n, np.frombuffer(data.buffers()[2], np.uint8), begin


def grams(data: np.ndarray, begin: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys of the depth + 1 bytes that end at each byte of the texts, and how many of them each text has; STEP bytes at a time."""
    for low in range(depth, int(begin[-1]), STEP):
        high = min(low + STEP, int(begin[-1]))
        key = np.zeros(high - low, np.uint64)
        for k in range(depth, -1, -1):
            key <<= np.uint64(8)
            key |= data[low - k : high - k]
        keep = np.ones(high - low, bool)
        for k in range(depth):  # the end bytes before each text
            at = begin[:-1] + k - low
            keep[at[(at >= 0) & (at < high - low)]] = False
        yield key[keep].view(np.int64), np.maximum(0, np.minimum(begin[1:], high) - np.maximum(begin[:-1] + depth, low))


def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values each."""
    out = np.zeros(len(n))
    if len(values):
        out[n > 0] = np.add.reduceat(values, (np.cumsum(n) - n)[n > 0])
    return out


def as_lists(values: pa.Array, keep: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Runs of n values each as lists of those to keep."""
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = before[np.concatenate([[0], np.cumsum(n)])]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values.filter(pa.array(keep)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of `docs` (text)."""

    def told(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for start, length in slices(batch.column("text"), 2 * STEP):
                found = prepared(batch.column("text").slice(start, length), 0)[0].value_counts()
                counts.update(dict(zip(found.field("values").to_numpy(zero_copy_only=False).tolist(), found.field("counts").to_pylist(), strict=True)))
                if len(counts) > 300_000:
                    yield told(counts)
                    counts.clear()
        yield told(counts)

    return docs.mapInArrow(counted, "word BINARY, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n) of each gram of depth + 1 bytes over all rows of `docs` (text)."""

    def told(found: list[pa.StructArray]) -> pa.RecordBatch:
        keys, counts = (np.concatenate([np.empty(0, np.int64), *(f.field(name).to_numpy() for f in found)]) for name in ("values", "counts"))
        return pa.RecordBatch.from_arrays(list(map(pa.array, summed(keys, counts))), ["key", "n"])

    def counted(batches):
        held: list[pa.StructArray] = []
        for batch in batches:
            for start, length in slices(batch.column("text"), 2 * STEP):
                _, _, data, begin = prepared(batch.column("text").slice(start, length), depth)
                for keys, _ in grams(data, begin, depth):
                    held.append(pa.array(keys).value_counts())
                    if sum(map(len, held)) > 1_000_000:
                        yield told(held)
                        held = []
        yield told(held)

    return docs.mapInArrow(counted, "key BIGINT, n BIGINT").groupBy("key").agg(F.sum("n").alias("n"))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def frequent(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """The rows of `counts` with the highest n, `most` at most for each value of `by`; whole classes of n.

    Counts are classed by eighths of a power of two, so the histogram has a few hundred rows at most.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy(*by, level.alias("level")).agg(F.count("*").alias("c")).collect()
    least: dict[tuple, int] = {}
    for key in {tuple(r[b] for b in by) for r in histogram}:
        total, least[key] = 0, 1 << 30
        for r in sorted((r for r in histogram if tuple(r[b] for b in by) == key), key=lambda r: -r.level):
            total += r.c
            if total > most:
                break
            least[key] = r.level
    keep = F.lit(False)
    for key, low in least.items():
        here = F.lit(True)
        for b, v in zip(by, key, strict=True):
            here &= F.col(b) == v
        keep |= here & (level >= low)
    return counts.where(keep)


def log_gamma(x, log=np.log):
    """Stirling's series after six steps of the recurrence; exact to 1e-10 for x >= 0.5. x: an array, or a column with its log."""
    y = x + 6
    steps = log(x * (x + 1) * (x + 2)) + log((x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * log(y) - y + math.log(2 * math.pi) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - steps


def kt(zeros, ones, log=np.log):
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def bit_nodes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted bit nodes (context, then the byte's first bits after a leading one) of sorted grams; their zeros and ones."""
    node, zeros, ones = [], [], []
    symbol = keys & np.uint64(255)
    for k in range(8):  # grams are sorted, so are their first bits
        each = keys & ~np.uint64(255) | np.uint64(1 << k) | symbol >> np.uint64(8 - k)
        bit = (symbol >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, each[1:] != each[:-1]][: len(each)])
        node.append(each[first])
        for counted, weight in ((zeros, 1 - bit), (ones, bit)):
            counted.append(np.add.reduceat(n * weight, first) if len(first) else np.empty(0, np.int64))
    order = np.argsort(found := np.concatenate(node))
    return found[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def whole(batches: Iterator[pa.RecordBatch], first: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of rows that are sorted by `first` and dealt by its context, all rows of a context together."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        held = {name: np.concatenate([held[name], v]) for name, v in new.items()} if held else new
        context = held[first] >> 8
        done = int(np.searchsorted(context, context[-1])) if len(context) else 0
        if done:
            yield {name: v[:done] for name, v in held.items()}
            held = {name: v[done:] for name, v in held.items()}
    if held and len(held[first]):
        yield held


def by_context(frame: DataFrame, key: str) -> DataFrame:
    return frame.repartition(F.shiftright(key, 8)).sortWithinPartitions(key)


def leaves(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of all bit nodes of some contexts, their counts, and log10 of the last byte's probability."""
    prefix, context = node & 255, node & ~255
    up = np.searchsorted(node, context | prefix >> 1)  # the node of one bit less
    log = np.log10(np.array([1 - one, one]))
    so_far = np.zeros(len(node))
    for k in range(1, 8):
        at = np.flatnonzero(prefix >> k == 1)
        so_far[at] = so_far[up[at]] + log[prefix[at] & 1, up[at]]
    at = np.flatnonzero(prefix >> 7 == 1)
    keys = [context[at] | (prefix[at] << 1 & 255) | bit for bit in (0, 1)]
    keys, n, value = np.concatenate(keys), np.concatenate([zeros[at], ones[at]]), np.concatenate([so_far[at] + log[0, at], so_far[at] + log[1, at]])
    return keys[n > 0], n[n > 0], value[n > 0]


def parent(node: str, depth: int) -> Column:
    """The node or gram of the next shorter context, from one of `depth` bytes."""
    return F.col(node).bitwiseAND((1 << 8 * depth) - 1)


def train(docs: DataFrame, depth: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """(key, n, value) of each gram of depth + 1 bytes in the texts of `docs`, value being log10 of its last byte's
    probability, and for each depth (node, one): the probability of a one at each bit node."""

    def opened(batches):
        for part in whole(batches, "key"):
            node, zeros, ones = bit_nodes(part["key"].view(np.uint64), part["n"])
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(zeros), pa.array(ones)], ["node", "a", "b"])

    def closed(batches):
        for part in whole(batches, "node"):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, leaves(part["node"], part["a"], part["b"], part["one"]))), ["key", "n", "value"])

    # From the leaves: the weight of a node's own estimate against that of its children.
    deepest = by_context(gram_counts(docs, depth), "key").mapInArrow(opened, "node BIGINT, a BIGINT, b BIGINT")
    nodes = [stored(deepest.withColumn("mixed", kt(F.col("a"), F.col("b"), F.log)).withColumn("own", F.lit(1.0)), "nodes")]
    for d in range(depth, 0, -1):
        shorter = nodes[0].groupBy(parent("node", d).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("mixed").alias("split"))
        estimate = shorter.withColumn("estimate", kt(F.col("a"), F.col("b"), F.log))
        mixed = F.greatest("estimate", "split") + F.log1p(F.exp(-F.abs(F.col("estimate") - F.col("split")))) - math.log(2)
        own = F.exp(F.col("estimate") - math.log(2) - F.col("mixed"))
        nodes.insert(0, stored(estimate.withColumn("mixed", mixed).select("node", "a", "b", "mixed", own.alias("own")), "nodes"))
    # From the root: what the shorter contexts put in, and what they leave to the longer ones.
    final: list[DataFrame] = []
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    for d, each in enumerate(nodes):
        if d == 0:
            each = each.withColumns({"before": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            above = final[-1].select(F.col("node").alias("up"), F.col("put").alias("before"), F.col("left").alias("rest"))
            each = each.join(above, parent("node", d) == F.col("up"))
        more = ["a", "b"] if d == depth else [(F.col("before") + F.col("rest") * F.col("own") * one).alias("put"), (F.col("rest") * (1 - F.col("own"))).alias("left")]
        final.append(stored(each.select("node", (F.col("before") + F.col("rest") * one).alias("one"), *more), "mixture"))
    grams_ = stored(by_context(final[-1], "node").mapInArrow(closed, "key BIGINT, n BIGINT, value DOUBLE"), "grams")
    return grams_, [f.select("node", "one") for f in final]


def unseen(keys: DataFrame, mixture: list[DataFrame]) -> DataFrame:
    """(key, value) of distinct grams (key) of which not all bit nodes are known: each bit by its deepest known context."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(7)))
    context, symbol = F.col("key").bitwiseAND(~255), F.col("key").bitwiseAND(255)
    shift = lambda by: F.call_function("shiftright", symbol, by)
    each = keys.select("key", bit.alias("k")).select(
        "key",
        context.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k"))).bitwiseOR(shift(8 - F.col("k"))).alias("node"),
        shift(7 - F.col("k")).bitwiseAND(1).alias("bit"),
        F.lit(None).cast("double").alias("p"),
    )
    for d in range(len(mixture) - 1, -1, -1):
        known = mixture[d].select(F.col("node").alias("known"), "one")
        node = F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1)
        each = each.join(known, node == F.col("known"), "left").select("key", "node", "bit", F.coalesce("p", "one").alias("p"))
    p = F.coalesce("p", F.lit(0.5))
    return each.groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit") == 1, p).otherwise(1 - p))).alias("value"))


def score(docs: DataFrame, folds: int = 5, held: int = 1, depth: int = 5, most: int = 1 << 20, most_words: int = 1 << 18) -> DataFrame:
    """Base and model log10 probabilities of each row of `docs`, learnt from rows outside fold `held`.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Tokens are
    the words and one end, which counts as a word of its own; null and empty texts have the end alone. A row
    without an id is not held out. Rows that repeat an id are scored, and learnt from, each. Without training
    rows nothing is known and each bit has probability 1/2. No documents give no rows. Only doc_id and text
    are read. `most` grams and `most_words` words are kept in the tasks at most; all others are joined.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    training = rows.where(~in_fold(F.col("doc_id"), folds, held)).select("text")
    words = stored(word_counts(training), "words")
    ends = training.count()
    n_words, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, distinct = total + ends, n_words + (ends > 0)
    known_grams, mixture = train(training, depth)
    top = frequent(known_grams, [], most).select("key", "value").toArrow().sort_by("key")  # at most `most` rows
    cache = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("key", "value")))
    common = frequent(words, [], most_words).toArrow()  # at most `most_words` rows
    known = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), np.log10(common.column("n").to_numpy() + 0.5).tolist(), strict=True)))
    end = float(np.log10(ends + 0.5))

    def scored(batches):
        (frequent_, value), get, serial = cache.value, known.value.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, length in slices(batch.column("text"), 2 * STEP):
                part = batch.slice(start, length)
                words, n_words, data, begin = prepared(part.column("text"), depth)
                # Each different word and gram of some texts is looked up once.
                coded = words.dictionary_encode()
                logs = np.array([get(w, np.nan) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], float)[coded.indices.to_numpy()]
                met = ~np.isnan(logs)
                base = per_text(np.where(met, logs, 0.0), n_words) + end
                n_known = per_text(met.astype(float), n_words).astype(np.int64) + (ends > 0)
                sums, missed, missed_of = np.zeros(length), [np.empty(0, np.int64)], np.zeros(length, np.int64)
                for keys, n in grams(data, begin, depth):
                    if not ends:
                        sums -= 8 * np.log10(2) * n
                        continue
                    each = pa.array(keys).dictionary_encode()
                    different, code = each.dictionary.to_numpy(), each.indices.to_numpy()
                    at = np.minimum(np.searchsorted(frequent_, different), max(len(frequent_) - 1, 0))
                    hit = frequent_[at] == different if len(frequent_) else np.zeros(len(different), bool)
                    sums += per_text((np.where(hit, value[at], 0.0) if len(frequent_) else np.zeros(len(different)))[code], n)
                    missed.append(keys[~hit[code]])
                    missed_of += per_text((~hit[code]).astype(float), n).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(missed_of)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(serial, serial + length), pa.int64()), part.column("doc_id"), pa.array(n_words + 1), pa.array(n_known), pa.array(base), pa.array(sums),
                     pa.array(np.diff(begin) - depth), as_lists(words, ~met, n_words), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(missed)))],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "coded", "n_bytes", "rare", "missed"],
                )
                serial += length

    schema = "row BIGINT, doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, base DOUBLE, coded DOUBLE, n_bytes BIGINT, rare ARRAY<BINARY>, missed ARRAY<BIGINT>"
    told = stored(rows.mapInArrow(scored, schema), "scored")
    # All other words, whatever their number, meet their counts in a join.
    others = told.select("row", F.explode("rare").alias("word")).join(words, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("also")
    )
    # So do all other grams, those that training never saw by their shorter contexts.
    pairs = told.select("row", F.explode("missed").alias("key"))
    found = stored(pairs.select("key").distinct().join(known_grams.select("key", "value"), "key", "left"), "missed")
    values = found.where("value IS NOT NULL").unionByName(unseen(found.where("value IS NULL").select("key"), mixture))
    coded = pairs.join(values, "key").groupBy("row").agg(F.sum("value").alias("joined"))
    score_ = F.col("coded") + F.coalesce("joined", F.lit(0.0))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return told.drop("rare", "missed").join(others, "row", "left").join(coded, "row", "left").select(
        "doc_id",
        in_fold(F.col("doc_id"), folds, held).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        score_.alias("score"),
        (-score_ / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's code length, learnt from four fifths of them."""
    return score(table(spark, folder, "documents"))
