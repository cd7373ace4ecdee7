"""Carried-state scans against a plain walk over each meeting, whatever the blocks, keys and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import consensus as C
from colloquy.operators import events as E
from colloquy.operators import scan
from colloquy.operators import shards as S
from colloquy.sources.shared import fresh
from colloquy.streaming import stateful as T

SCHEMA = "meeting_id string, speaker_id string, seq long, vec array<double>, n long"


def cosine(a, b):
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(np.clip(a @ b / size, -1, 1)) if size else 0.0


def walked(rows):
    """n -> (cos, score, delta, drift, stale), row by row as the definition says."""
    out, meetings = {}, {}
    for m, who, _, vec, n in sorted(rows, key=lambda r: r[4]):
        who = who or ""
        st = meetings.setdefault(m or "", {"ref": None, "score": 0.0, "last": {}, "first": {}, "heard": set()})
        stale = vec is None
        if vec == [] or stale and who not in st["last"]:
            continue
        v = st["last"][who] if stale else np.array(vec)
        st["heard"].add(who)
        st["first"].setdefault(who, v)
        cos = 0.0 if st["ref"] is None else cosine(v, st["ref"])
        was, st["score"] = st["score"], 0.2 * cos + 0.8 * st["score"]
        st["ref"] = sum(st["last"].values(), np.zeros(len(v))) / len(st["heard"])
        st["last"][who] = v
        out[n] = (cos, st["score"], st["score"] - was, 1 - cosine(v, st["first"][who]), stale)
    return out


def restarting(rng, n=160):
    """Clients number their messages from 1 each; arrival gives the order."""
    seqs, rows = {}, []
    for i in range(n):
        m, who = [None, "", "m", "m", "m"][rng.integers(5)], [None, "a", "b", "c", "d", "e"][rng.integers(6)]
        seqs[m, who] = seqs.get((m, who), 0) + 1
        vec = [None, []][rng.integers(2)] if rng.random() < 0.2 else rng.standard_normal(4).tolist()
        rows.append((m, who, seqs[m, who] if rng.random() > 0.1 else None, vec, i))
    return rows


def arriving(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("arrived_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") * 17))


def at(df):
    """consensus's rows by the number of the row they belong to: arrival orders them, so ord tells which kept row of the meeting."""
    return {(r["meeting_id"], r["ord"]): (r["cos"], r["score"], r["delta"], r["drift"], r["stale"]) for r in df.collect()}


def numbered(rows):
    want, count, out = walked(rows), {}, {}
    for m, _, _, _, n in rows:
        if n in want:
            count[m or ""] = count.get(m or "", 0) + 1
            out[m or "", count[m or ""]] = want[n]
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert np.allclose(got[k][:4], w[:4], atol=1e-9) and got[k][4] == w[4], (k, got[k], w)


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_consensus_equals_the_walk(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rows = restarting(np.random.default_rng(block))
    close(at(C.consensus(arriving(spark, rows))), numbered(rows))


def test_speakers_with_their_own_numbers_and_no_arrival(spark):
    """Two speakers numbered 1 to 4 each: their rows are rows of their own, in order of seq, then speaker."""
    rng = np.random.default_rng(2)
    rows = [("m", who, s, rng.standard_normal(3).tolist(), 2 * s + (who == "b")) for who in "ab" for s in range(1, 5)]
    df = spark.createDataFrame(rows, SCHEMA).drop("n")
    got = at(C.consensus(df))
    close(got, numbered(sorted(rows, key=lambda r: r[4])))
    assert max(abs(v[0]) for v in got.values()) > 0.3


def test_stream_with_restarting_numbers(spark):
    rows = restarting(np.random.default_rng(9), 60)
    df = arriving(spark, rows)
    want = sorted(((m, s[1], s[3]) for m, s in ((k[0], v) for k, v in numbered(rows).items())), key=str)
    out, path, checkpoint = [], fresh(spark, "in"), fresh(spark, "state")
    for a, b in ((0, 25), (25, 60)):
        df.where((F.col("n") >= a) & (F.col("n") < b)).coalesce(1).write.mode("append").parquet(path)
        stream = T.consensus(spark.readStream.schema(df.schema).parquet(path))
        T.run_to_end(stream.writeStream.outputMode("append").foreachBatch(lambda rows, _: out.extend(rows.collect())), checkpoint)
    got = sorted(((r["meeting_id"], r["score"], r["drift"]) for r in out), key=str)
    assert len(got) == len(want) and np.allclose(sorted(g[1] for g in got), sorted(w[1] for w in want)) and np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want))


def test_a_meeting_with_all_rows_runs_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 50)
    rows = [("m", "ab"[i % 2], i, [1.0, i % 3 + 0.5], i) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = scan.with_references(df).groupBy("block").count().collect()
    assert len(blocks) >= 20 and max(r["count"] for r in blocks) <= 51


@pytest.mark.parametrize("block", [4, 1024])
def test_clocks(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rows = restarting(np.random.default_rng(3), 90)
    got = {r["n"]: r["vclock"] for r in E.with_clocks(arriving(spark, rows)).collect()}
    seen: dict = {}
    for m, who, _, _, n in rows:
        own = seen.setdefault(m or "", {})
        own[who or ""] = own.get(who or "", 0) + 1
        assert got.pop(n) == own
    assert not got


def test_clocks_of_a_thousand_speakers(spark):
    df = spark.range(2000).select(F.lit("m").alias("meeting_id"), F.concat(F.lit("s"), F.col("id") % 1000).alias("speaker_id"), F.col("id").alias("seq"))
    sizes = E.with_clocks(df).select("seq", F.size("vclock").alias("k"), F.aggregate(F.map_values("vclock"), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum")).collect()
    assert sorted((r["seq"], r["k"], r["sum"]) for r in sizes) == [(i, min(i + 1, 1000), i + 1) for i in range(2000)]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "Etc/UTC"])
def test_times_pass_whatever_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(4).select(F.lit("m").alias("meeting_id"), F.lit("s").alias("speaker_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 9).alias("arrived_at"), F.array(F.struct(F.timestamp_seconds("id").alias("t"))).alias("more"))
        rows = S.timed_shards(E.with_clocks(df), 10).select("seq", F.unix_timestamp("arrived_at").alias("at"), F.unix_timestamp(F.col("more")[0]["t"]).alias("t"), "first", F.unix_timestamp("opened_at").alias("o"), F.map_values("vclock")[0].alias("n")).collect()
        assert sorted(tuple(r) for r in rows) == [(i, 9 * i, i, i // 2 * 2 + 1, 18 * (i // 2), i + 1) for i in range(4)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
