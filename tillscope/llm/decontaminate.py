"""Benchmark decontamination by winnowing.

Of each window of `winnow` consecutive k-gram hashes the smallest is kept as a fingerprint, for documents and
benchmark items alike. With k + winnow - 1 = 10 words, any shared span of ten words holds a whole window,
hence a shared fingerprint. Fingerprints are joined, and each hit is extended: the ten-word spans around it
are joined with the items' windows word by word. Items shorter than ten words have one window each; their
lengths are few (1 to 9), and each length is joined by its own n-gram hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.shared import ascii_lower, let, stored, table

SPAN = 10
GRAM = 5


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z to a-z; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def each_run(values: Column, n: int, of: Callable[..., Column]) -> Column:
    """`of` of each value and the n - 1 after it; at the end, of those that are left (as nulls)."""
    return let(values, lambda all_values: F.transform(all_values, lambda v, i: of(v, *(F.get(all_values, i + k) for k in range(1, n)))))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def marks_of(words: Column, gram: int, winnow: int) -> Column:
    """Winnowed fingerprints (mark, pos) of a text; pos counts words from 0.

    A gram hash is kept if it is the minimum of one of the windows of `winnow` grams that it is part of. The
    last few grams and windows are cut short by the end of the text; that adds marks and takes none away.
    """

    def chosen(hashes: Column) -> Column:
        def mark(minima: Column) -> Column:
            def mine(h: Column, i: Column) -> Column:
                return reduce(Column.__or__, (F.coalesce(F.get(minima, i - k) == h, F.lit(False)) for k in range(winnow)))

            return F.transform(hashes, lambda h, i: F.when(mine(h, i), F.struct(h.alias("mark"), i.alias("pos"))))

        return F.array_compact(let(each_run(hashes, winnow, F.least), mark))

    return let(each_run(word_hashes(words), gram, F.xxhash64), chosen)


def item_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """(n, window, item_id): each window of n words of each item, once.

    n is `span`, or the length of a shorter item. Items without words have none.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    words = items.select("item_id", "words", F.least(F.size("words"), F.lit(span)).alias("n"))
    starts = words.select("item_id", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("start"))
    return starts.select("n", F.array_join(F.slice("words", F.col("start"), F.col("n")), " ").alias("window"), "item_id").distinct()


def hits_of(docs: DataFrame, windows: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_id, sig, spans): where each document may hold a window, as (start, n), by shared hashes."""
    winnow = span - gram + 1
    words = F.split("window", " ")
    lengths = [r.n for r in windows.select("n").distinct().orderBy("n").collect()]  # at most `span` values
    found = []
    if span in lengths:
        full = windows.where(F.col("n") == span)
        prints = stored(full.select(F.explode(marks_of(words, gram, winnow).getField("mark")).alias("mark")).distinct(), "item-marks")
        marks = docs.select("doc_id", "sig", F.explode(marks_of(words_of(F.col("text")), gram, winnow)).alias("m"))
        shared = marks.select("doc_id", "sig", "m.*").join(prints, "mark", "left_semi")
        starts = F.sequence(F.greatest(F.col("pos") - (winnow - 1), F.lit(0)), "pos")
        found.append(shared.select("doc_id", "sig", F.explode(starts).alias("start"), F.lit(span).alias("n")))
    for n in (n for n in lengths if n < span):
        of_length = windows.where(F.col("n") == n)
        prints = stored(of_length.select(F.get(each_run(word_hashes(words), n, F.xxhash64), F.lit(0)).alias("mark")).distinct(), "item-marks")
        grams = docs.select("doc_id", "sig", F.posexplode(each_run(word_hashes(words_of(F.col("text"))), n, F.xxhash64)).alias("start", "mark"))
        found.append(grams.join(prints, "mark", "left_semi").select("doc_id", "sig", "start", F.lit(n).alias("n")))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id BIGINT, sig BIGINT, spans ARRAY<STRUCT<start: INT, n: INT>>")
    every = reduce(DataFrame.unionAll, found)
    return every.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as (doc_id, sig, n_words); each occurrence of an item window in them as
    (doc_id, sig, start, n, window_id), start counting words from 0; and the items of each window as (window_id, item_id).

    Both read one stored table. Candidate spans hold their words, so that hits are verified exactly.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sig"), "text")
    held = stored(item_windows(benchmark.select("item_id", "text"), span), "item-windows")
    # Documents meet each window once, however many items hold it.
    windows = stored(held.select("n", "window").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    hits = stored(hits_of(docs, windows, span, gram).select(F.col("doc_id").alias("hit_id"), F.col("sig").alias("hit_sig"), "spans"), "hits")
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sig") == F.col("hit_sig")), "left")
    read = lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.transform(
            "spans",
            lambda s: F.struct(
                s["start"].alias("start"), s["n"].alias("n"), F.array_join(F.slice(words, s["start"] + 1, s["n"]), " ").alias("window")
            ),
        ).alias("spans"),
    )
    texts = stored(joined.select("doc_id", "sig", let(words_of(F.col("text")), read).alias("r")).select("doc_id", "sig", "r.*"), "spans")
    spans = texts.select("doc_id", "sig", F.explode("spans").alias("s")).distinct().select("doc_id", "sig", "s.*")
    found = spans.join(windows, ["n", "window"]).select("doc_id", "sig", "start", "n", "window_id")
    return texts.select("doc_id", "sig", "n_words"), found, held.join(windows, ["n", "window"]).select("window_id", "item_id")


def lists_of(items: DataFrame, sets: DataFrame) -> DataFrame:
    """(windows, item_ids): the items of each set of windows, sorted as strings. Documents with the same windows share a set."""
    each = sets.select("windows").distinct().select("windows", F.explode("windows").alias("window_id"))
    named = each.join(items.where("item_id IS NOT NULL"), "window_id").select("windows", F.col("item_id").cast("string").alias("item"))
    return named.distinct().groupBy("windows").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """How far each document overlaps with benchmark items.

    An item's windows are its runs of `span` words, or the whole item where it is shorter. A document word
    inside an occurrence of a window is hit. Result, one row per row of `docs`: doc_id, n_words, n_hit,
    item_ids (sorted as strings), contaminated; with `digest`, n_items and items_sha256 (of the ids, joined by commas) in place
    of item_ids, so that no list goes to a document. Null or wordless texts have no words and no hits; items
    without words match nothing; items without an id count for hits, not as items. Rows that repeat id and
    text get equal results. An empty benchmark hits nothing. Only doc_id, text, item_id are read.
    """
    texts, found, items = overlaps(docs, benchmark, span, gram)
    found = stored(found, "found")
    by_start = Window.partitionBy("doc_id", "sig").orderBy("start", "n")
    reach = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = found.select("doc_id", "sig", "start", "n", (F.col("start") + F.col("n")).alias("end")).select(
        "doc_id", "sig", F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0)).alias("new_words")
    )
    words = covered.groupBy("doc_id", "sig").agg(F.sum("new_words").alias("n_hit"))
    # A document's set of windows is no longer than the document.
    sets = stored(found.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_set("window_id")).alias("windows")), "window-sets")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    told = {"item_ids": ids}
    if digest:
        told = {"n_items": F.size(ids).cast("bigint"), "items_sha256": F.sha2(F.array_join(ids, ",").cast("binary"), 256)}
    lists = lists_of(items, sets)
    lists = stored(lists.select("windows", *(v.alias(k) for k, v in told.items())), "item-lists")
    per_text = _null_safe(words, sets.join(lists, "windows", "left").drop("windows"))
    nothing = {"item_ids": F.array().cast("array<string>"), "n_items": F.lit(0).cast("bigint"), "items_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    hits = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return _null_safe(texts, per_text).select(
        "doc_id", "n_words", hits.alias("n_hit"), *(F.coalesce(k, nothing[k]).alias(k) for k in told), (hits > 0).alias("contaminated")
    )


def _null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by (doc_id, sig) where a null id equals a null id."""
    other = right.withColumnsRenamed({"doc_id": "other_id", "sig": "other_sig"})
    on = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("sig") == F.col("other_sig"))
    return left.join(other, on, "left").drop("other_id", "other_sig")


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of a benchmark item."""
    _, found, _ = overlaps(docs, benchmark, span, gram)
    hit = stored(found.select(F.col("doc_id").alias("hit_id"), F.col("sig").alias("hit_sig")).distinct(), "contaminated")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sig"), F.struct("*").alias("row"))
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sig") == F.col("hit_sig"))
    return keyed.join(hit, on, "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), digest=True)


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)
), spans AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, s, spans.n AS n, item_id FROM spans JOIN windows USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
