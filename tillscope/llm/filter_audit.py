"""Filter interaction audit: which filters of a chain remove what, in every order.

Each filter is a set of failing documents. Four look at one text; the fifth fails copies, which an existential
self-join finds: a document stays in the semi-join on hash, exact text and a smaller doc_id. The failing ids of
all filters are united to one bit pattern for each document, patterns are counted for each part of the table,
and those counts (32 at most for a part) answer every order of the filters: documents meet no order.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.shared import stored, table

FILTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D by one text: short, repetitive, many capitals, odd characters."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def copies(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, sig, part) of the rows of `docs` whose exact text a row of smaller doc_id holds.

    `keys` are the rows without their texts. Only texts whose hash two ids share are compared. The other side of
    the semi-join is first reduced to the smallest doc_id of each text, so a text with a third of all rows is
    one row there, and adaptive execution can split its copies on this side.
    """
    shared = stored(keys.groupBy("sig").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("sig"), "shared")
    held = stored(docs.join(shared, "sig", "left_semi"), "copies")
    first = stored(held.groupBy("sig", "text").agg(F.min("doc_id").alias("first")), "first").alias("f")
    same = (F.col("d.sig") == F.col("f.sig")) & (F.col("d.text") == F.col("f.text")) & (F.col("f.first") < F.col("d.doc_id"))
    return held.alias("d").join(first, same, "left_semi").select("doc_id", "sig", "part")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, docs, good, toxic): documents of each part by the bits of the filters that they fail."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("sig", F.xxhash64("text"))
    fails = sum((failed.cast("int") * BIT[name] for name, failed in text_failures(F.col("text")).items()), F.lit(0))
    by_text = stored(rows.select("doc_id", "sig", "part", fails.alias("fails"), F.lit(1).alias("n")), "failures")
    by_copy = copies(rows, by_text).distinct().select("doc_id", "sig", "part", F.lit(BIT["E"]).alias("fails"), F.lit(0).alias("n"))
    united = by_text.unionByName(by_copy).groupBy("doc_id", "sig", "part").agg(F.bit_or("fails").alias("fails"), F.sum("n").alias("docs"))
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        *(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic")))
    )
    marked = united.join(told, "doc_id", "left")
    count = lambda c: F.sum(F.col("docs") * F.coalesce(c, F.lit(0)))
    return marked.groupBy("part", "fails").agg(F.sum("docs").alias("docs"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def orders() -> list[dict]:
    """One entry per order and step: the filter's bit and the bits of those before it."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            found.append({"filter_order": "".join(order), "step": step, "before": before, "bit": BIT[letter], "place": FILTERS.index(letter)})
            before |= BIT[letter]
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of every order, for each part (`source`) of `docs`.

    Result, 600 rows for each part: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A null source is the part "". Null text counts as empty; an empty text
    fails A alone (and E). Rows that repeat an id count each; copies under one id do not fail E, since no id
    is smaller. A row without an id is neither smaller nor larger than another, so it never fails E, and has
    no labels. An id that is labelled twice is good (toxic) if one row says so; ids without labels are
    neither. Texts are read whole, whatever their length. No documents give no rows. Only doc_id, source, text,
    quality and toxic are read, so further columns of any name do no harm.
    """
    counts = patterns(docs, labels)
    # clear: documents that fail no filter of a set, for each of the 32 sets. Long lists of columns are quicker written as SQL.
    clear = counts.groupBy("part").agg(
        *(F.expr(f"array({', '.join(f'sum(if(fails & {s} = 0, {c}, 0))' for s in range(ALL + 1))})").alias(c) for c in COUNTS)
    )

    def shapley(bit: int) -> str:
        weight = lambda before: factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count())
        return " + ".join(f"{weight(s)} * (docs[{s}] - docs[{s | bit}])" for s in range(ALL + 1) if not s & bit)

    every = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order: string, step: int, before: int, bit: int, place: int>>")
    each = clear.select("part", *COUNTS, F.expr(f"array({', '.join(map(shapley, BIT.values()))})").alias("shapley"), F.explode(every).alias("o")).select("*", "o.*")
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    return each.select(
        "part",
        "filter_order",
        "step",
        F.get("docs", after).alias("kept"),
        lost("docs").alias("removed"),
        (F.get("docs", F.lit(0)) - F.get("docs", F.col("bit")) - lost("docs")).alias("redundant"),
        (F.get("docs", ALL - F.col("bit")) - F.get("docs", F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("place")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All orders of the five filters over every document."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), first AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), marked AS (
  SELECT part,
         CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first < d.doc_id, false) AS INT) AS m,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN first USING (t)
  LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
), combos AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM marked GROUP BY part, m
), letters(l, b) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS o
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31
), steps AS (
  SELECT o, s, l, b, coalesce((SELECT CAST(sum(y.b) AS INT) FROM letters y WHERE strpos(o, y.l) < s), 0) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s), letters WHERE l = substr(o, CAST(s AS INT), 1)
), told AS (
  SELECT part, o, s, l, coalesce(sum(n) FILTER (WHERE m & (before | b) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE m & before = 0 AND m & b <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE m & before <> 0 AND m & b <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE m = b), 0) AS unique_fails,
         coalesce(sum(g) FILTER (WHERE m & before = 0 AND m & b <> 0), 0) AS good_lost,
         coalesce(sum(x) FILTER (WHERE m & before = 0 AND m & b <> 0), 0) AS toxic_lost
  FROM combos, steps GROUP BY part, o, s, l
)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM told
"""
