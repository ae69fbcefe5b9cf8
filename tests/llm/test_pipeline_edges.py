"""Every stage of the pipeline on odd rows, on clashing columns and on no rows."""

import pytest

import corpus_pipeline
from tillscope.llm.shared import stored

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, row STRING, sig BIGINT, score DOUBLE, predicted INT, lost STRING, class_id INT,"
    " window_id INT, spans STRING, held INT"
)


@pytest.fixture(scope="module")
def odd(spark):
    line = "a line that is long enough to count as one that many share"
    texts = [None, "", "!!", "!!", " \t\n", "word", f"{line}\n{line}\nown", "x" * 100_000, " ".join(f"w{k}" for k in range(20_000))] + [f"{line}\n{k} more" for k in range(8)]
    rows = [(k, t, "en", None, 1) for k, t in enumerate(texts)] + [(None, "no id", None, "s", None), (None, None, None, None, None), (3, "!!", "en", "s", 2), (5, "other", "en", "s", 5)]
    return stored(spark.createDataFrame([(*r, "r", 7, 0.5, 1, "l", 2, 3, "s", 4) for r in rows], SCHEMA), "odd")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_none(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    after = stored(stage(spark, odd, SMALL), "stage")
    none = stage(spark, odd.where("false"), SMALL)
    assert none.count() == 0 and none.columns == after.columns
    if name == "packing":
        assert after.groupBy("doc_id").count().count() == odd.select("doc_id").distinct().count()
        return
    assert after.columns == odd.columns
    # What stays keeps its other columns; only line dedup changes texts.
    kept = [c for c in odd.columns if name != "line dedup" or c not in ("text", "n_chars")]
    assert after.select(kept).exceptAll(odd.select(kept)).count() == 0
    if name == "line dedup":
        assert after.count() == odd.count() and after.where("text IS NULL").count() == odd.where("text IS NULL").count()
    if name == "n-gram Jaccard join":
        left = [(r.doc_id, r.text) for r in after.collect()]
        assert sum(t == "!!" for _, t in left) == 1 and sum(i is None for i, _ in left) == 2
