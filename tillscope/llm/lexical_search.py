"""Ranked lexical search for many items at once, by common-subexpression evaluation.

An item's score of a document is a sum over its terms, and items share terms. Shared term sets are mined: terms
that the same items hold, then pairs of sets that follow each other in several items' lists, again and again. Each set is a
node of a graph whose sum is made once for a block of documents; an item is the sum of the few nodes that are left of it.

Documents are read once: their lengths and the counts of searched terms are stored. Every task keeps the best of its own
documents for each item, so that no more than those leave it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.shared import ship, stored, table

#: A-Z to a-z; digits, letters and all bytes of other characters stay, the rest of ASCII parts terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Characters of texts whose terms are counted together.
TOGETHER = 1_000_000
#: Cells of the sums of a block of documents.
CELLS = 1 << 22
LOWEST = -(1 << 63)
FOUND = "item BIGINT, item_id BIGINT, doc_id BIGINT, score BIGINT"


def terms_of(text: str | None) -> list[bytes]:
    """The terms [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text, A-Z in lower case; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


@dataclass
class Graph:
    """How the sums of a block of items are made. Nodes 0, 1, ... are terms, then come sums of earlier nodes."""

    terms: list[bytes] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)
    items: list[int] = field(default_factory=list)

    @property
    def nodes(self) -> int:
        return len(self.terms) + len(self.sums)

    @property
    def additions(self) -> int:
        return sum(len(s) - 1 for s in self.sums)

    def add(self, parts: list[int]) -> int:
        """The node that sums `parts`."""
        if len(parts) == 1:
            return parts[0]
        self.sums.append(parts)
        return self.nodes - 1

    def evaluate(self, cells: np.ndarray) -> np.ndarray:
        """Sums of all items, a row each; `cells` has a row for each node, those of terms filled."""
        for k, parts in enumerate(self.sums, len(self.terms)):
            np.add(cells[parts[0]], cells[parts[1]], out=cells[k])
            for part in parts[2:]:
                cells[k] += cells[part]
        return cells[self.items]


def shared_sums(items: list[set[bytes]]) -> Graph:
    """The graph of items, each a set of terms with one at least.

    Linear in the terms of all items for each round of pairing; a round halves the longest repeated run.
    """
    holders: dict[bytes, list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for term in terms:
            holders[term].append(i)
    graph = Graph(sorted(holders))
    number = {term: k for k, term in enumerate(graph.terms)}
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for term in graph.terms:
        alike[tuple(holders[term])].append(number[term])
    lists: list[list[int]] = [[] for _ in items]
    # Sets of many items first, so that items begin alike.
    for held in sorted(alike, key=lambda held: (-len(held), held)):
        node = graph.add(alike[held])
        for i in held:
            lists[i].append(node)
    while True:
        counts = Counter(pair for nodes in lists for pair in pairwise(nodes))
        taken: set[int] = set()
        made: dict[tuple[int, int], int] = {}
        for pair in sorted((p for p, n in counts.items() if n > 1), key=lambda p: (-counts[p], p)):
            if not taken & {*pair}:
                taken.update(pair)
                made[pair] = graph.add([*pair])
        if not made:
            break
        for i, nodes in enumerate(lists):
            new: list[int] = []
            for node in nodes:
                if new and (new[-1], node) in made:
                    new[-1] = made[new[-1], node]
                else:
                    new.append(node)
            lists[i] = new
    graph.items = [graph.add(nodes) for nodes in lists]
    return graph


def blocks_of(items: DataFrame, most: int) -> Iterator[tuple[list[int | None], list[set[bytes]]]]:
    """The ids and terms of items, in blocks of `most` terms or one longer item. The driver holds one block, and
    one partition of `items` as it comes."""
    ids: list[int | None] = []
    sets: list[set[bytes]] = []
    held = 0
    for row in items.toLocalIterator():
        terms = {*terms_of(row.text)}
        if not terms:
            continue
        if ids and held + len(terms) > most:
            yield ids, sets
            ids, sets, held = [], [], 0
        ids.append(row.item_id)
        sets.append(terms)
        held += len(terms)
    if ids:
        yield ids, sets


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row of `docs` that has a term: all its terms, and the counts of those in `terms` by number."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({term: k for k, term in enumerate(terms)})  # a block of items' terms

    def counted(batches):
        get = known.value.get

        def told(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
            n = np.fromiter(map(len, words), np.int64, len(words))
            number = np.fromiter(map(get, (w for each in words for w in each), repeat(-1)), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(words)), n)[number >= 0]
            key, tf = np.unique(owner * max(1, len(terms)) + number[number >= 0], return_counts=True)
            owner, number = np.divmod(key, max(1, len(terms)))
            offsets = pa.array(np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (number.astype(np.int32), tf)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

        ids, words, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if found:
                    ids.append(doc_id)
                    words.append(found)
                    size += len(found)
                if size * 6 > TOGETHER:
                    yield told(ids, words)
                    ids, words, size = [], [], 0
        if ids:
            yield told(ids, words)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(counted, "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, tfs ARRAY<BIGINT>")


def weights(held: DataFrame, n_terms: int, n_docs: int) -> np.ndarray:
    """Of each term by number, from the number of documents that hold it."""

    def counted(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    sums = held.select("terms").mapInArrow(counted, "term BIGINT, df BIGINT").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of a block
    df = np.zeros(n_terms, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def best(held: DataFrame, ids: list[int | None], graph: Graph, weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """FOUND: the `k` best documents of each item among those of each task; null ids first among equal scores."""
    model = held.sparkSession.sparkContext.broadcast((ids, graph, weight))  # a block of items

    def searched(batches):
        item_ids, sums, w = model.value
        width = max(1, min(4096, CELLS // max(1, sums.nodes)))
        cells = np.zeros((sums.nodes, width), np.int64)
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in item_ids]  # score, doc_id, whether it is null
        least = np.ones(len(item_ids), np.int64)  # a score that may still enter
        for batch in batches:
            for start in range(0, len(batch), width):
                part = batch.slice(start, width)
                size, terms, tf = (part.column("terms").value_lengths().to_numpy(), part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy())
                m = np.array([50 + 50 * n * n_docs // n_words for n in part.column("n").to_pylist()], np.int64)
                owner = np.repeat(np.arange(len(part)), size)
                cells[: len(w)] = 0
                cells[terms, owner] = w[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
                scores = sums.evaluate(cells[:, : len(part)])
                null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc_id = part.column("doc_id").fill_null(LOWEST).to_numpy()
                for i in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                    at = np.flatnonzero(scores[i] >= least[i])
                    every = [np.concatenate([old, new]) for old, new in zip(kept[i], (scores[i, at], doc_id[at], null[at]), strict=True)]
                    order = np.lexsort((~every[2], every[1], -every[0]))[:k]
                    kept[i] = tuple(v[order] for v in every)
                    if len(order) == k:
                        least[i] = kept[i][0][-1]
        for i, (score, doc_id, null) in enumerate(kept):
            if len(score):
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([item_ids[i]] * n, pa.int64()), pa.array(doc_id, mask=null), pa.array(score)], ["item", "item_id", "doc_id", "score"]
                )

    return held.mapInArrow(searched, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 1 << 16) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of each item, fewer where fewer score above 0.

    With N documents that have terms, L terms in all, n terms in the document, df documents that hold a term and tf
    of it in the document: w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L; a score is the sum
    of w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms. Equal scores rank by ascending doc_id, a null id
    first; rows that repeat an id rank each. Null, empty and termless documents count nowhere. Each row of `items`
    (item_id, text) is an item, also where ids are null or repeat; termless ones have no rows, nor has any item
    where there are no documents. Other columns are not read. Very long texts are read whole.

    Items are searched in blocks of at most `block_terms` terms (or one longer item), each against all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    found = []
    for ids, sets in blocks_of(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text"), block_terms):
        graph = shared_sums(sets)
        held = stored(postings(docs, graph.terms), "postings")
        n_docs, n_words = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weight = weights(held, len(graph.terms), n_docs)
        rows = best(held, ids, graph, weight, n_docs, n_words, k)
        order = [F.desc("score"), F.asc_nulls_first("doc_id")]
        # Tasks' best meet in 64 groups of each item first, however many tasks there were.
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "item_id", "deal").orderBy(*order))).where(F.col("rank") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item", "item_id").orderBy(*order))).where(F.col("rank") <= k)
        found.append(stored(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    return reduce(DataFrame.unionAll, found)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 50 documents for each benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), n AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n
), tf AS (
  SELECT doc_id, w, count(*) AS tf FROM t SEMI JOIN q USING (w) GROUP BY doc_id, w
), df AS (
  SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), s
), part AS (
  SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS part
  FROM tf JOIN n USING (doc_id) JOIN df USING (w), s
), scored AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN part USING (w) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
