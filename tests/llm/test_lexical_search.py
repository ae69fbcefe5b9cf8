"""Lexical search against brute force, and its graph of shared sums against plain sums."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillscope.llm import lexical_search
from tillscope.llm.shared import stored

SMALL = "/root/testdata/sf0.001"
DOCS = [
    (1, "The cat sat on the mat"), (2, "the CAT-cat, été Été"), (3, None), (4, ""), (5, "!! \x1c"), (6, "dog " * 2000 + "cat"), (7, "a1 b2 a1"), (8, "mat mat mat"),
    (9, "mat mat mat"), (9, "mat mat mat"), (9, "the end"), (None, "mat mat mat"), (10, "x" * 100_000 + " mat"),
] + [(20 + k, f"filler number {k} of the many mat{k % 7}") for k in range(60)]
ITEMS = [(1, "the cat"), (2, "mat"), (3, None), (4, "?!"), (5, "the cat on the mat"), (6, "absent words"), (6, "dog"), (None, "été cat"), (7, "the cat"), (8, "of many filler mat3 mat4 the")]


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    words, df = sum(n for *_, n in docs), Counter(w for _, c, _ in docs for w in c)
    want = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * len(docs)) // words
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in {*terms(text)} if c[w])
            if s > 0:
                found.append((-s, i is not None, i or 0))
        want += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, want))


def test_search_equals_brute_force(spark):
    docs = stored(spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id BIGINT, text STRING, item_id STRING, rank INT").repartition(5), "searched")
    items = spark.createDataFrame([(*i, 0.5) for i in ITEMS], "item_id BIGINT, text STRING, score DOUBLE")
    for k, block in ((50, 1 << 16), (3, 4), (1, 1)):
        got = lexical_search.search(docs, items, k, block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute(DOCS, ITEMS, k)
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("item_id = 3")).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12).map(lambda n: b"t%d" % n), min_size=1), min_size=1, max_size=12))
def test_shared_sums_equal_plain_sums(items):
    graph = lexical_search.shared_sums(items)
    value = np.random.default_rng(len(items)).integers(0, 1 << 40, (len(graph.terms), 3))
    cells = np.zeros((graph.nodes, 3), np.int64)
    cells[: len(value)] = value
    plain = [sum(value[graph.terms.index(t)] for t in terms) for terms in items]
    assert (graph.evaluate(cells) == np.array(plain)).all()
    assert graph.additions <= sum(len(terms) - 1 for terms in items)


def test_shared_sets_are_made_once():
    common = {b"c%d" % k for k in range(30)}
    items = [common | {b"own%d" % k} for k in range(20)] + [common] * 5
    graph = lexical_search.shared_sums(items)
    assert graph.additions == 29 + 20  # the common set once, then one addition for each item with a term of its own
    assert len({*graph.items[20:]}) == 1


def test_oracle(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    got = lexical_search.op13_lexical_search(spark, SMALL)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({lexical_search.OP13_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and want
