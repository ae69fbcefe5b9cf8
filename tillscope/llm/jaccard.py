"""N-gram Jaccard join by MinHash banding.

Texts are sets of hashed five-word shingles. Texts with equal sets are copies and form one node. Nodes whose
MinHash signatures agree in a band meet in a bucket; the numbers of bands and rows follow from the target
recall at the threshold. Pairs that meet are verified on full sets, inside a task. Buckets are joined into
candidate components, so that each text travels once; a component that is too large for one task is taken apart
into its buckets, and those into blocks, where a pair is counted in the first band in which it meets. Either way
the same pairs are counted. Only counts and spanning links leave a task, never the pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.quality import MIX, hashes
from tillscope.llm.shared import ship, stored, table

WORD = re.compile(r"\w+")


def banding(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` rows that find a pair at `threshold` with chance `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted set of hashed runs of n words, in lower case; a shorter text is one run, a wordless one none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes().__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    run = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        run = (run ^ (run >> np.uint64(29))) * MIX + h[k : len(h) - n + 1 + k]
    return np.unique((run ^ (run >> np.uint64(32))) * MIX)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band from the smallest of `values` under bands * rows hash functions."""
    state = np.random.default_rng(8).integers(1, 1 << 63, (2, bands * rows), np.uint64)
    factor, shift = state[0] * np.uint64(2) + np.uint64(1), state[1]
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for start in range(0, len(values), 1024):
        part = values[start : start + 1024, None] * factor + shift
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0))
    grid, key = least.reshape(bands, rows), np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = (key ^ (key >> np.uint64(29))) * MIX + grid[:, k]
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, sig, set1, set2, n_shingles, bands) of each row. A text without words stands for itself: its set hashes are those
    of the text, and it has no bands."""
    ship(docs.sparkSession)

    def signed(batches):
        import xxhash

        for batch in batches:
            one, two, size, keys = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = shingles(text, n)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes() if len(found) else b"text" + text.encode("utf-8", "surrogatepass")), np.int64)
                one.append(int(digest[0]))
                two.append(int(digest[1]))
                size.append(len(found))
                keys.append(band_keys(found, bands, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), *(pa.array(c, pa.int64()) for c in (one, two, size)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "sig", "set1", "set2", "n_shingles", "bands"],
            )

    return docs.mapInArrow(signed, "doc_id BIGINT, sig BIGINT, set1 BIGINT, set2 BIGINT, n_shingles BIGINT, bands ARRAY<BIGINT>")


def told(rows: DataFrame, by: list[str], facts: DataFrame, total: int) -> DataFrame:
    """`rows` joined by `by` with `facts`, which has one row for each key and, as `held`, how many of the `total` rows have it.

    Keys of more than a 2,000th of all rows, fewer than 2,000, are broadcast, so that no task has all rows of a hub.
    """
    many = max(total // 2000, 100)
    hubs = F.broadcast(facts.where(F.col("held") > many))  # fewer than 2,000, as their rows add up to `total` at most
    rest = rows.join(F.broadcast(facts.where(F.col("held") > many).select(*by)), by, "left_anti")
    return rows.join(hubs, by).unionByName(rest.join(facts.where(F.col("held") <= many), by))


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of each node in `links` (a, b); root is the smallest node of its component.

    Alternates large and small stars: each step hangs a node's larger, then its smaller neighbours on the
    smallest. The number of steps is logarithmic, and each step's links are written out.
    """

    def stars(links: DataFrame, small: bool, n: int) -> DataFrame:
        both = links if small else links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held"))
        hung = told(both, ["a"], least, n if small else 2 * n)
        if small:
            return hung.select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e")).select(F.col("e.a"), F.col("e.m").alias("b"))
        return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))

    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stored(down, label)
    n, state = now.count(), None
    while True:
        larger = stored(stars(now, False, n).where("a <> b").distinct(), label)
        step = stars(larger, True, larger.count())
        now = stored(step.where("a <> b").distinct(), label)
        # A sum over hashed links tells whether anything has changed.
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        n, state = after[0], after


def linked(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the `wanted` pairs (a boolean matrix, upper triangle) have a Jaccard index of `threshold` or more."""
    n = np.array([len(s) for s in sets])
    with np.errstate(divide="ignore", invalid="ignore"):
        wanted = wanted & (np.minimum.outer(n, n) >= (threshold - 1e-9) * np.maximum.outer(n, n))
    pairs = np.argwhere(wanted)
    shared = np.zeros(wanted.shape, np.float32)
    if len(pairs) <= 16 * len(sets):
        for i, j in pairs:
            shared[i, j] = np.intersect1d(sets[i], sets[j], assume_unique=True).size
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        _, place, count = np.unique(every, return_inverse=True, return_counts=True)
        keep = count[place] > 1
        column = (np.cumsum(count > 1) - 1)[place[keep]]
        owner = owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = 2048
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[low:high], column[low:high] - start] = 1
            shared += part @ part.T
    union = np.add.outer(n, n) - shared
    return wanted & (shared >= threshold * union - 1e-6)


def verify(units: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, texts, docs, root) of each node in each unit: how many nodes and documents it links to there,
    and the smallest node that links connect it with there.

    A unit has members (node, size, bands, text), a band whose pairs count that share no earlier one (-1: pairs that share any),
    and sides 1, 2 or both (3).
    """

    def checked(rows: list[dict]) -> pa.RecordBatch:
        band = rows[0]["band"]
        side = np.array([r["side"] for r in rows])
        wanted = np.triu(np.ones((len(rows), len(rows)), bool), 1)
        if not (side == 3).all():
            wanted &= side[:, None] != side[None, :]
        keys = np.array([r["bands"] for r in rows], np.int64)
        met = np.zeros(wanted.shape, bool)
        for k in range(keys.shape[1] if band < 0 else band):
            met |= keys[:, k, None] == keys[None, :, k]
        wanted &= met if band < 0 else ~met  # an earlier band has counted the pair
        links = linked([shingles(r["text"], n) for r in rows], wanted, threshold)
        links |= links.T
        size = np.array([r["size"] for r in rows], np.int64)
        node = np.array([r["node"] for r in rows], np.int64)
        root = node.copy()
        top = np.iinfo(np.int64).max
        while True:  # the smallest node spreads along the links
            least = np.minimum(root, np.where(links, root[None, :], top).min(axis=1))
            if (least == root).all():
                break
            root = least
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(links.sum(axis=1).astype(np.int64)), pa.array(links.astype(np.int64) @ size), pa.array(root)], ["node", "texts", "docs", "root"]
        )

    def grouped(batches) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["band"], row["key"], row["low"], row["high"])
                if key != unit and rows:
                    yield checked(rows)
                    rows = []
                unit = key
                rows.append(row)
        if rows:
            yield checked(rows)

    key = ["band", "key", "low", "high"]
    dealt = units.repartition(*key).sortWithinPartitions(*key, "node")
    return dealt.mapInArrow(grouped, "node BIGINT, texts BIGINT, docs BIGINT, root BIGINT")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, most: int = 1024, most_shingles: int = 1 << 21) -> DataFrame:
    """Links between documents whose sets of n-word shingles have a Jaccard index of `threshold` or more.

    Words are \\w+ in lower case. Result, one row per row of `docs`: doc_id; class_id, the smallest doc_id
    that links connect it with (its own if none); copy_id, the smallest doc_id with the same set; n_copies,
    rows with the same set, itself included; n_texts, other sets that it links to; n_links, other rows that
    it links to, copies included; sig, a hash of the text. A text of fewer than n words is one shingle. Texts without words
    link to equal texts only; null and empty text are equal. Rows without an id link to nothing and have no class. Rows that repeat an id are
    rows of their own. No documents give no rows. Only doc_id and text are read. A task holds about
    `most` texts and `most_shingles` of their shingles, or two longer texts; neither changes a result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sig"), "text")
    bands, rows = banding(threshold, recall)
    signed = stored(signatures(docs, n, bands, rows), "signatures")
    known = signed.where(F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "sig", "bands", "n_shingles"))
    sets = known.groupBy("set1", "set2").agg(first.alias("f"), F.count("*").alias("size"))
    nodes = stored(
        sets.select(F.monotonically_increasing_id().alias("node"), "set1", "set2", "f.doc_id", "f.sig", "f.bands", "f.n_shingles", "size"), "nodes"
    )
    met = stored(nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")), "met")
    buckets = met.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("held"), F.sum("n_shingles").alias("weight"))
    buckets = stored(buckets.where("held > 1"), "buckets")
    members = stored(told(met, ["band", "key"], buckets, met.count()), "members")
    candidates = components(members.select(F.col("node").alias("a"), F.col("least").alias("b")), "candidates")
    placed = stored(candidates.union(candidates.select("root", "root").distinct()).join(nodes.select("node", "n_shingles"), "node"), "candidates")
    sizes = placed.groupBy("root").agg(F.count("*").alias("held"), F.sum("n_shingles").alias("weight"))
    placed = stored(told(placed.select("node", "root"), ["root"], sizes, placed.count()), "placed")
    # Small components are one unit each; of larger ones each bucket is one, in pairs of blocks.
    zero = F.lit(0)
    fits = (F.col("held") <= most) & (F.col("weight") <= most_shingles)
    whole = placed.where(fits).select("node", F.lit(-1).alias("band"), F.col("root").alias("key"), zero.alias("low"), zero.alias("high"), F.lit(3).alias("side"))
    count = F.greatest(F.ceil(F.col("held") / (most // 2)), F.ceil(F.col("weight") / (most_shingles // 2))).cast("int")
    block = F.when(fits, 0).otherwise(F.pmod(F.xxhash64("node"), count).cast("int"))
    other = F.when(fits, F.array(zero)).otherwise(F.sequence(zero, count - 1))
    parts = (
        members.join(placed.where(~fits).select("node"), "node")
        .select("node", "band", "key", block.alias("own"), F.explode(other).alias("other"))
        .select("node", "band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    )
    # Texts of candidates only; equal rows give a text once.
    chosen = stored(placed.select("node").join(nodes, "node").select("node", "doc_id", "sig", "size", "bands"), "chosen")
    texts = docs.join(chosen, ["doc_id", "sig"]).dropDuplicates(["node"])
    texts = stored(texts.select("node", "size", "bands", "text"), "texts")
    units = whole.union(parts).join(texts, "node")
    found = stored(verify(units, n, threshold), "verified")
    counts = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    grown = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    classed = grown.union(grown.select("root", "root").distinct())
    named = stored(classed.join(nodes.select("node", "doc_id"), "node"), "named")
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("held"))
    classes = counts.join(told(named.select("node", "root"), ["root"], names, named.count()).select("node", "class_id"), "node", "left")
    per_set = stored(
        nodes.join(classes, "node", "left").select(
            "set1", "set2", F.col("doc_id").alias("copy_id"), F.col("size").alias("held"),
            F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("texts", F.lit(0)).alias("n_texts"), F.coalesce("docs", F.lit(0)).alias("docs"),
        ),
        "per-set",
    )
    rows_ = known.select("doc_id", "sig", "set1", "set2")
    linking = told(rows_, ["set1", "set2"], per_set, known.count()).select(
        "doc_id", "class_id", "copy_id", F.col("held").alias("n_copies"), "n_texts", (F.col("docs") + F.col("held") - 1).alias("n_links"), "sig"
    )
    alone = signed.where(F.col("doc_id").isNull())
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return linking.union(alone.select("doc_id", "doc_id", "doc_id", one, none, none, "sig"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate classes and link counts of every document."""
    return jaccard_join(table(spark, folder, "documents")).drop("sig")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, without near copies: of each class the smallest doc_id stays.

    Rows that repeat id and text stay once; so does a text without words that many rows hold. Rows without an id all stay.
    """
    classes = jaccard_join(docs, threshold, n)
    stay = stored(classes.where(F.col("class_id") == F.col("doc_id")).select("doc_id", "sig").distinct(), "stay")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sig"), F.struct("*").alias("row"))
    kept = keyed.join(stay, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"])
    return kept.select("row.*").union(docs.where(F.col("doc_id").isNull()))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) GROUP BY a, b
), near AS (
  SELECT a, b, k = x.n AND k = y.n AS same FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)
  UNION ALL SELECT x.doc_id, y.doc_id, true FROM w x JOIN w y USING (t) WHERE len(x.w) = 0
), reach(a, b) AS (
  SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
), copies AS (
  SELECT a AS doc_id, min(b) AS copy_id, count(*) AS n_copies FROM near WHERE same GROUP BY a
), links AS (
  SELECT a AS doc_id, count(DISTINCT copy_id) - 1 AS n_texts, count(*) - 1 AS n_links FROM near JOIN copies ON doc_id = b GROUP BY a
)
SELECT doc_id, class_id, copy_id, n_copies, n_texts, n_links
FROM (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a) JOIN copies USING (doc_id) JOIN links USING (doc_id)
"""
