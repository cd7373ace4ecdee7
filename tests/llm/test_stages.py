"""Pipeline stages on nulls, empty texts, repeated ids, clashing names and empty tables."""

import numpy as np

import corpus_pipeline
from colloquy.llm.quality import OrdinalModel, rate_quality

COLUMNS = "doc_id long, text string, n_chars long, _row string, _id string, node long, _words string, kept boolean"


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, ""), (None, None), (2, " "), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (3, "other words under the same id, quite different from those"), (None, "a text without an id that nothing else is like"), (4, "secret = 'abcdefGHIJ1234567890' here"), (5, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "r", "i", 7, "w", True) for i, t in rows], COLUMNS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == docs.columns, name
        texts = sorted(r["text"] for r in now.select("text").collect())
        if k == 0:
            assert texts == sorted(t for _, t in rows if t and t.strip())
        if k in (1, 2):
            assert texts == sorted({t for _, t in rows if t and t.strip()})
    assert len(texts) == 5 and not any("GHIJ" in t for t in texts) and all(r["n_chars"] == len(r["text"]) for r in now.collect())
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_run_leaves_no_scratch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g", 13), (2, "h i j k l m n", 13)], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}


def test_stages_send_texts_once_and_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "a fine text"), (2, " "), (3, None)], "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for _, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.set(name, "10000")
        stage(spark, docs, "")
        assert int(spark.conf.get(name)) <= 1000
    spark.conf.set(name, "10000")
    model = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([-20.0, -10.0]))
    rated = rate_quality(docs, model)
    assert int(spark.conf.get(name)) <= 1000 and "_text" not in rated._jdf.queryExecution().optimizedPlan().toString()
    assert {r["_row"]["doc_id"]: r["_kept"] for r in rated.collect()} == {1: True, 2: False, 3: False}
