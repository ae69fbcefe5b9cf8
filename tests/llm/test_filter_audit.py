"""The filter audit against brute force over all orders, with nulls, repeats and odd columns."""

import re
from itertools import permutations

import duckdb

from tillscope.llm import filter_audit
from tillscope.llm.shared import stored

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, None, "a"), (5, "", None), (6, "", ""), (7, "SHOUT " * 300, "b"), (8, LONG + " #1", "b"),
    (9, LONG + " #1", "a"), (10, "same " * 400, "a"), (10, "same " * 400, "a"), (10, LONG, "a"), (None, LONG, "b"), (None, "x", None), (11, " \t\n\x0b", "c"),
    (12, LONG.upper(), "c"), (13, "é" * 300 + " |", "c"), (0, "w\x0bw\x0cw w", "c"), (14, LONG * 400, "c"), (15, LONG * 400, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (8, 1, None), (12, None, 1), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len({*w}) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows) else set()
        docs.append((source or "", fails, doc_id in good, doc_id in toxic))
    want = {}
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                lost, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = [d for d in here if f in d[1]]
                total[f] += len(lost)
                want[part, "".join(order), step] = [
                    len(left), len(lost), len(failing) - len(lost), sum(d[1] == {f} for d in here), sum(d[2] for d in lost), sum(d[3] for d in lost), f,
                ]
        for key, value in want.items():
            if key[0] == part:
                value[-1] = total[value[-1]]
    return {k: tuple(v) for k, v in want.items()}


def result(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_every_order_equals_brute_force(spark):
    odd = [(*r, "x", 1, 2) for r in ROWS]
    docs = stored(spark.createDataFrame(odd, "doc_id BIGINT, text STRING, source STRING, part STRING, fails INT, quality INT"), "audited")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id BIGINT, quality INT, toxic INT, source STRING")
    assert result(filter_audit.audit(docs, labels)) == brute(ROWS, LABELS)
    assert result(filter_audit.audit(docs, labels.where("false"))) == brute(ROWS, [])
    assert filter_audit.audit(docs.where("false"), labels).count() == 0


def test_copies_are_compared_by_text_not_by_hash_alone(spark):
    rows = spark.createDataFrame([(1, 7, "p", "a"), (2, 7, "p", "b"), (3, 7, "p", "a"), (4, 8, "p", "a")], "doc_id BIGINT, sig BIGINT, part STRING, text STRING")
    assert [r.doc_id for r in filter_audit.copies(rows, rows.drop("text")).collect()] == [3]


def test_semi_join_splits_a_hot_text(spark):
    hot = spark.range(60_000).selectExpr("id AS doc_id", "repeat('the same text ', 20) AS text")
    names = ["skewedPartitionThresholdInBytes", "skewedPartitionFactor"]
    keys = [f"spark.sql.adaptive.skewJoin.{n}" for n in names] + ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("64k", "1.5", "64k", "-1"), strict=True):
            spark.conf.set(k, v)
        rows = hot.selectExpr("doc_id", "xxhash64(text) AS sig", "'p' AS part", "text")
        found = filter_audit.copies(rows, rows.drop("text"))
        assert len(found.collect()) == 59_999
        assert "skew=true" in found._jdf.queryExecution().toString()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_oracle(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    got = filter_audit.op11_filter_audit(spark, SMALL)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({filter_audit.OP11_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and want
