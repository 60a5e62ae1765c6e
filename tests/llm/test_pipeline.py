"""The pipeline's stages against plain versions, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from mirrorlake.llm.common import documents, labels
from tests.llm.test_near_duplicates import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def test_stages(spark):
    docs = documents(spark, DATA).cache()
    verdicts = {r.doc_id: r for r in labels(spark, DATA).collect()}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], DATA).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    good = [i for i in ids[0] if i in verdicts and verdicts[i].quality == 1]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    clean = [i for i in ids[1] if i in verdicts and verdicts[i].toxic == 0]
    assert sum(i in ids[2] for i in clean) >= 0.95 * len(clean)
    want = brute([(r.doc_id, r.text) for r in frames[2].collect()], 5, 80)
    assert ids[3] == {i for i, (_, c) in want.items() if i == c}
    tokens = frames[4].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in tokens)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows, columns named like the operators' own, and an empty table."""
    rows = [(i, f"word{i} " * 30 + f"and some more of {i}", "en", "a", 1, 0.5, "x") for i in range(12)]
    rows += [(1, rows[1][1], "en", "a", 1, 0.5, "x"), (20, rows[2][1], None, None, None, None, None), (None, "no id at all", "en", "a", 1, 0.5, "x"), (21, None, "en", "a", 1, 0.5, "x"), (22, "", "en", "a", 1, 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    frame = documents(spark, f"{tmp_path}/odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, f"{tmp_path}/odd")
        assert frame.columns == docs.columns
    kept = [r.doc_id for r in frame.collect()]
    assert 20 not in kept and kept.count(1) <= 2 and kept.count(None) <= 1
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in out} == set(kept) and sum(r.start == 0 for r in out) == len(kept)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
