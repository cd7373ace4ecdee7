"""Vectors are kept between jobs, models are pinned, tokens are pooled under their mask; alerts, exports and warehouse files."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.vectors import masked_mean
from colloquy.operators import embedding as M
from colloquy.operators import shards as S
from colloquy.operators import slo
from colloquy.sources.shared import fresh


def sizes():
    """A model that gives a text's length. It is made here, so that workers needn't know this file."""
    most = M.AT_ONCE

    def embed(texts):
        assert len(texts) <= most
        return [[float(len(t))] for t in texts]

    return lambda: embed


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, redacted_text string")


def test_a_second_run_embeds_new_texts_only(spark):
    path = fresh(spark, "vectors")
    first = M.embed_kept(texts(spark, "a", "A ", "bb", None, ""), sizes(), 1, "sizes", path)
    assert {(r["id"], r["vec"][0]) for r in first.collect()} == {(0, 2.0), (1, 2.0), (2, 2.0), (3, 0.0), (4, 0.0)}
    assert M.kept_vectors(spark, path).count() == 3
    second = M.embed_kept(texts(spark, "bb", "ccc", "a"), sizes(), 1, "sizes", path)
    assert [r["vec"][0] for r in second.orderBy("id").collect()][:2] == [2.0, 3.0] and M.kept_vectors(spark, path).count() == 4
    M.embed_kept(texts(spark, "bb"), sizes(), 1, "other", path)
    assert M.kept_vectors(spark, path).count() == 5


def test_many_texts_and_known_vectors(spark):
    df = texts(spark, *[f"text {i}" for i in range(300)])
    known = spark.createDataFrame([(hashlib.sha256(b"text 7").hexdigest(), [-1.0])], "key string, vec array<double>")
    got = {r["id"]: r["vec"][0] for r in M.embed(df, sizes(), 1, "sizes", known).collect()}
    assert got[7] == -1.0 and all(got[i] == len(f"text {i}") for i in range(300) if i != 7)
    with pytest.raises(Exception, match="one vector of the stated length"):
        M.embed(df, lambda: lambda t: [[1.0]] * (len(t) - 1), 1, "short").collect()


def test_a_pin_that_does_not_hold_stops_the_job(spark, tmp_path):
    (tmp_path / "config.json").write_text("{}")
    M.check_pin(spark, str(tmp_path / "config.json"), hashlib.sha256(b"{}").hexdigest())
    with pytest.raises(ValueError, match="isn't the pinned one"):
        M.check_pin(spark, str(tmp_path / "config.json"), "0" * 64)


def test_masked_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal((n, 3)).tolist(), rng.integers(0, 2, n).tolist()) for i, n in enumerate([1, 2, 5, 9, 4])] + [(5, [[1.0, 2.0]], [0]), (6, [], []), (7, None, [1])]
    got = {r["id"]: r["m"] for r in spark.createDataFrame(rows, "id long, t array<array<double>>, mask array<int>").select("id", masked_mean("t", "mask").alias("m")).collect()}
    for i, t, mask in rows[:5]:
        assert np.allclose(got[i], (np.array(t) * np.array(mask)[:, None]).sum(axis=0) / max(sum(mask), 1))
    assert got[5] == [0.0, 0.0] and got[6] is None and got[7] is None
    with pytest.raises(Exception, match="don't fit"):
        spark.createDataFrame([([[1.0], [1.0, 2.0]], [1, 1])], "t array<array<double>>, mask array<int>").select(masked_mean("t", "mask")).collect()


def test_alerts_take_the_columns_they_name(spark):
    rows = [(1_704_067_200 + 10 * i, "breaker_open", "b", float(i % 3 != 2)) for i in range(12)] + [(None, "breaker_open", "b", 1.0)]
    samples = spark.createDataFrame(rows, "t long, metric string, label string, value double").select(F.timestamp_seconds("t").alias("ts"), "metric", "label", "value")
    assert slo.alerts(samples).count() == 0
    on = samples.withColumn("value", F.lit(1.0))
    assert [(r["name"], r["windows"]) for r in slo.alerts(on).collect()] == [("BreakerOpen", 4)]


def test_names_with_hyphens_are_exported_apart(spark):
    rows = [("a-b", "c", 1), ("a", "b-c", 1), ("a", "b", 1), ("a", "b", 1), ("a", None, 1), ("a%2Db", "c", 1)]
    df = spark.createDataFrame([(*r, 1_704_067_200 + i) for i, r in enumerate(rows)], "meeting_id string, speaker_id string, seq long, t long")
    df = df.select("meeting_id", "speaker_id", "seq", F.timestamp_seconds("t").alias("arrived_at"), F.lit("x").alias("redacted_text"), F.create_map(F.lit("a"), F.lit(1).cast("bigint")).alias("vclock"))
    docs = S.shard_documents(S.assign_shards(df))
    out = S.export(docs.unionByName(docs))
    assert out.count() == 6 and out.select("utterance_id").distinct().count() == 5


def test_shards_and_warehouse_read_back(spark):
    df = spark.createDataFrame([(m, s, i, 1_704_067_200 + 50_000 * i) for m in "ab" for s in "xy" for i in range(3)], "meeting_id string, speaker_id string, seq long, t long")
    df = df.select("meeting_id", "speaker_id", "seq", F.timestamp_seconds("t").alias("arrived_at"), F.lit("x").alias("redacted_text"), F.create_map(F.lit("a"), F.lit(1).cast("bigint")).alias("vclock"))
    docs, path, house = S.shard_documents(S.assign_shards(df)), fresh(spark, "shards"), fresh(spark, "warehouse")
    S.write_shards(docs, path)
    S.write_shards(docs.where("meeting_id = 'a'").limit(1), path)
    got = spark.read.parquet(path)
    assert {(r["meeting_id"], r["count"]) for r in got.groupBy("meeting_id").count().collect()} == {("a", 1), ("b", docs.where("meeting_id = 'b'").count())}
    rows = S.export(docs)
    S.write_warehouse(rows, house)
    S.write_warehouse(rows.where(F.to_date("arrived_at") == "2024-01-02"), house)
    back = spark.read.parquet(house)
    assert back.count() == rows.count() == 12 and sorted({str(r["day"]) for r in back.select("day").distinct().collect()}) == ["2024-01-01", "2024-01-02"]
    for part in back.select(F.input_file_name().alias("f"), "meeting_id", "speaker_id").collect():
        own = [(r["meeting_id"], r["speaker_id"]) for r in spark.read.parquet(part["f"]).select("meeting_id", "speaker_id").collect()]
        assert own == sorted(own)
