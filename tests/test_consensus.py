import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import consensus as C
from colloquy.sources.shared import fresh
from colloquy.streaming import stateful as T

ROWS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("a", [1.0, 1.0]), ("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [-1.0, 0.0])]
SCHEMA = "meeting_id string, speaker_id string, seq long, vec array<double>"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([("m", s, i + 1, v) for i, (s, v) in enumerate(rows)], SCHEMA)


def test_worked_case(spark):
    rows = C.consensus(frame(spark)).orderBy("seq").collect()
    assert [round(r["cos"], 6) for r in rows] == [0, 0, 0.707107, 0.707107, 0.894427, -0.894427]
    assert [round(r["score"], 6) for r in rows] == [0, 0, 0.141421, 0.254558, 0.382532, 0.12714]
    assert [round(r["drift"], 6) for r in rows] == [0, 0, 0.292893, 1.0, 1.0, 2.0]
    refs = C.reference_vectors(frame(spark)).orderBy("seq").collect()
    assert [r["after"] for r in refs] == [[0, 0], [0.5, 0], [0.5, 0.5], [0.5, 1.0], [1.0, 0.5], [0.5, 0.5]]
    note = C.bridge_notes(C.consensus(frame(spark))).collect()
    assert [(n["seq"], n["tag"]) for n in note] == [(5, "speaker-drift")]


def test_sticky_and_dropped(spark):
    rows = [*ROWS[:5], ("a", None), ("c", None)]
    got = C.consensus(frame(spark, rows)).orderBy("seq").collect()
    assert [(r["seq"], r["stale"]) for r in got] == [(1, False), (2, False), (3, False), (4, False), (5, False), (6, True)]


def test_unequal_length_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        C.consensus(frame(spark, [("a", [1.0]), ("b", [1.0, 2.0])])).collect()


def test_stream_equals_batch(spark):
    rng = np.random.default_rng(1)
    rows = [(str(m), str(rng.integers(3)), s + 1, rng.standard_normal(5).tolist() if rng.random() > 0.2 else None) for m in range(3) for s in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r["meeting_id"], r["seq"]): r for r in C.consensus(df).collect()}
    for parts in (1, 3):
        path, out = fresh(spark, "in"), fresh(spark, "out")
        for k in range(parts):
            df.where((F.col("seq") > 25 * k // parts) & (F.col("seq") <= 25 * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(path)
        T.run_to_end(T.consensus(T.replayed(spark, path, SCHEMA)).writeStream.outputMode("append").format("parquet").option("path", out), fresh(spark, "state"))
        got = spark.read.parquet(out).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r["meeting_id"], r["seq"]]
            assert abs(r["score"] - w["score"]) < 1e-9 and abs(r["drift"] - w["drift"]) < 1e-9 and r["stale"] == w["stale"]


def test_score_range_and_empty(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if rng.random() < 0.5 else "b", rng.standard_normal(3).tolist()) for _ in range(60)]
    assert all(-1 <= r["score"] <= 1 and r["drift"] >= -1e-9 for r in C.consensus(frame(spark, rows)).collect())
    assert C.consensus(spark.createDataFrame([], SCHEMA)).count() == 0
