"""Streams in one batch and in several give their batch forms' results; expiry, restarts, retries and odd names."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.operators import consensus as C
from colloquy.operators import embedding as M
from colloquy.operators import events as E
from colloquy.operators import shards as S
from colloquy.operators import slo
from colloquy.operators.embedding import culture_windows
from colloquy.sources.shared import fresh
from colloquy.streaming import stateful as T


@pytest.fixture(autouse=True)
def one_partition(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", had)


def streamed(parts, made, mode="append", expiring=False):
    """made(stream)'s rows when the parts arrive one after another and the query is started anew for each."""
    spark = parts[0].sparkSession
    path, checkpoint = fresh(spark, "in"), fresh(spark, "checkpoint")
    rows = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        out = made(spark.readStream.schema(part.schema).parquet(path))
        T.run_to_end(out.writeStream.outputMode(mode).foreachBatch(lambda b, _: rows.extend(b.collect())), checkpoint, expiring)
    return rows


def halves(df, at):
    return [df.where(F.col("seq") < at), df.where(F.col("seq") >= at)]


def test_consensus_with_expiry(spark):
    rows = [("m", f"s{i % 3}", i, [float(i % 5), 1.0, float(i % 7)] if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "meeting_id string, speaker_id string, seq long, vec array<double>")
    want = {(r["seq"], round(r["score"], 9)) for r in C.consensus(df).collect()}
    for parts in ([df], halves(df, 9)):
        assert {(r["seq"], round(r["score"], 9)) for r in streamed(parts, lambda s: T.consensus(s, idle_ms=600_000), expiring=True)} == want


def test_clocks_of_odd_names_and_placeholders(spark):
    names = ['a"b', "c\\d", "é", None]
    df = spark.createDataFrame([("m", names[i % 4], i, "NAME") for i in range(8)], "meeting_id string, speaker_id string, seq long, kind string")
    for parts in ([df], halves(df, 3)):
        last = max(streamed(parts, lambda s: T.vector_clocks(s, 600_000), expiring=True), key=lambda r: r["seq"])
        assert json.loads(last["result"]) == {'a"b': 2, "c\\d": 2, "é": 2, "": 2}
        got = streamed(parts, T.placeholders)
        assert {(r["seq"], r["result"]) for r in got} == {(i, f"[NAME_{i + 1}]") for i in range(8)}


def shard_rows(spark, n=70):
    df = spark.createDataFrame([("m", "a", i, 1_704_067_200.0 + i / 10) for i in range(n)], "meeting_id string, speaker_id string, seq long, t double")
    return df.select("meeting_id", "speaker_id", "seq", F.timestamp_millis((F.col("t") * 1000).cast("bigint")).alias("arrived_at"), F.lit("x").alias("redacted_text"), F.create_map(F.lit("a"), F.lit(1).cast("bigint")).alias("vclock"))


def test_shards_go_on_across_batches(spark):
    df = shard_rows(spark)
    want = {(r["seq"], r["shard_id"]) for r in S.assign_shards(df).collect()}
    for parts in ([df], halves(df, 30)):
        assert {(r["seq"], r["shard_id"]) for r in streamed(parts, T.sharded)} == want
    sizes = S.shard_documents(S.assign_shards(df)).select("write_count").collect()
    assert sorted(r[0] for r in sizes) == [20, 50]


def test_sink_failures_go_to_dead_letters_once(spark):
    df = S.assign_shards(shard_rows(spark, 10))
    out, dead = fresh(spark, "shards"), fresh(spark, "dead")
    good = T.shard_writer(T.to_parquet(out), dead)
    good(df, 0)
    good(df, 0)
    assert S.shard_documents(df).count() == spark.read.parquet(out).count()

    def refuse(documents, number):
        raise OSError("away")

    bad = T.shard_writer(refuse, dead)
    bad(df, 1)
    bad(df, 1)
    lines = spark.read.json(dead)
    assert lines.count() == 10
    text = lines.select(F.to_json(F.struct("meeting_id", "seq", "ts", "payload")).alias("value"))
    events, broken = S.replay(text, "shard_id string, redacted_text string")
    done, sent = [], []
    S.reflush(events, lambda rows: sent.extend(rows.collect()), lambda: done.append(1))
    assert len(sent) == 10 and len({r["shard_id"] for r in sent}) == 1 and done == [1] and broken.count() == 0
    try:
        T.shard_writer(T.to_parquet(out), dead)(df.drop("vclock"), 2)
        raise AssertionError("a batch without clocks must stop the stream")
    except Exception as e:
        assert "vclock" in str(e)


def running(df, made, mode, until, limit=60, parts=1):
    """made(stream)'s rows while a query runs by the clock, until they are enough. df's rows are there from the start."""
    spark = df.sparkSession
    path, rows = fresh(spark, "in"), []
    df.coalesce(1).write.parquet(path)
    out = made(spark.readStream.schema(df.schema).parquet(path))
    query = out.writeStream.outputMode(mode).foreachBatch(lambda b, _: rows.extend(b.collect())).trigger(processingTime="1 second").option("checkpointLocation", fresh(spark, "checkpoint")).start()
    end = time.time() + limit
    while time.time() < end and query.isActive and not until(rows):
        time.sleep(0.5)
    query.stop()
    return rows


def test_hot_snapshots(spark):
    kinds = ["utterance", "consensus", "bridge"]
    rows = [("m", i, kinds[i % 3], i / 10, i % 2 == 0, 1_704_067_200 + 10 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "meeting_id string, seq long, type string, value double, stale boolean, t long").withColumn("arrived_at", F.timestamp_seconds("t"))
    for parts in ([df], halves(df, 8)):
        last = max(streamed(parts, lambda s: T.hot_snapshots(s, 60), "update", expiring=True), key=lambda r: r["last_at"])
        seqs = [i for p in parts for (i,) in p.select("seq").collect() if i > 13]
        assert last["events"] == ",".join(f"{i}:{kinds[i % 3]}" for i in sorted(seqs)) and last["n_events"] == len(seqs)
    assert (last["score"], last["stale"]) == (1.9, False)


def test_a_quiet_meeting_ages_out(spark):
    rows = [("m", i, "consensus", 0.5, False, 1_704_067_200 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "meeting_id string, seq long, type string, value double, stale boolean, t long").withColumn("arrived_at", F.timestamp_seconds("t"))
    got = running(df, lambda s: T.hot_snapshots(s, 3), "update", lambda rows: len(rows) > 1)
    assert [(r["n_events"], r["events"]) for r in got] == [(3, "0:consensus,1:consensus,2:consensus"), (0, "")]


def greedy(times, seconds, most):
    """For each event (seconds) the number of the one that opens its shard."""
    out, first = [], None
    for i, t in enumerate(times):
        if first is None or t >= times[first] + seconds or i - first >= most:
            first = i
        out.append(first + 1)
    return out


@pytest.mark.parametrize("walk", [8, 4096])
def test_timed_shards_follow_the_rule(spark, monkeypatch, walk):
    monkeypatch.setattr(S, "WALK", walk)
    rng = random.Random(walk)
    rows, want = [], {}
    for m in ("a", "b", "c"):
        times = sorted(rng.choice([rng.uniform(0, 300), rng.uniform(40, 44)]) for _ in range(rng.choice([1, 90, 161])))
        rows += [(m, "s", i, t) for i, t in enumerate(times)]
        want |= {(m, i): f for i, f in enumerate(greedy([round(t * 1000) for t in times], 10_000, 4))}
    df = spark.createDataFrame(rows, "meeting_id string, speaker_id string, seq long, t double").withColumn("arrived_at", F.timestamp_millis(F.round(F.col("t") * 1000).cast("bigint")))
    got = S.timed_shards(df, 10, 4).collect()
    assert len(got) == len(rows) and {(r["meeting_id"], r["seq"]): r["first"] for r in got} == want
    assert all(len({r["opened_at"] for r in got if r["shard_id"] == s}) == 1 for s in {r["shard_id"] for r in got})


def test_timed_shards_come_out_by_time(spark):
    df = shard_rows(spark, 70).unionByName(shard_rows(spark, 2).withColumn("meeting_id", F.lit("quiet")))
    want = {(r["meeting_id"], r["shard_id"], r["start_ts"], r["end_ts"], r["write_count"], tuple(e["seq"] for e in r["events"])) for r in S.shard_documents(S.timed_shards(df, 5, 40)).collect()}
    got = running(df, lambda s: T.timed_shards(s, 5, 40), "append", lambda rows: len(rows) >= len(want))
    assert {(r["meeting_id"], r["shard_id"], r["start_ts"], r["end_ts"], r["write_count"], tuple(e["seq"] for e in r["events"])) for r in got} == want and len(got) == len(want) == 3
    for parts in ([df.where("meeting_id = 'm'")], halves(df.where("meeting_id = 'm'"), 30)):
        rows = streamed(parts, lambda s: T.timed_shards(s, 5, 40), expiring=True)
        assert [tuple(e["seq"] for e in r["events"]) for r in rows] == [tuple(range(40))]


def test_own_state_survives_a_restart(spark):
    """A query stopped between batches goes on from its checkpoint, and its state can be read."""
    rng = random.Random(2)
    rows = [("m" if i % 3 else "k", "abc"[i % 3 - i % 2], i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "meeting_id string, speaker_id string, seq long, vec array<double>")
    whole = {(r["meeting_id"], r["seq"]): r["score"] for r in C.consensus(df).collect()}
    path, checkpoint, got = fresh(spark, "in"), fresh(spark, "checkpoint"), {}
    for part in (df.where("seq < 11"), df.where("seq >= 11 and seq < 20"), df.where("seq >= 20")):
        part.coalesce(1).write.mode("append").parquet(path)
        out = T.consensus(spark.readStream.schema(df.schema).parquet(path))
        T.run_to_end(out.writeStream.outputMode("append").foreachBatch(lambda b, _: got.update({(r["meeting_id"], r["seq"]): r["score"] for r in b.collect()})), checkpoint)
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-9 for k in whole)
    state = spark.read.format("statestore").option("stateVarName", "meeting").load(checkpoint).select("key.meeting_id", "value.score", "value.speakers").collect()
    last = {m: max(s for k, s in whole if k == m) for m in ("m", "k")}
    assert {r["meeting_id"]: round(r["score"], 9) for r in state} == {m: round(whole[m, last[m]], 9) for m in last}
    clocks, checkpoint = {}, fresh(spark, "checkpoint")
    for until in (11, 20, 30):
        part = fresh(spark, "part")
        df.where((F.col("seq") < until) & (F.col("seq") >= (0 if until == 11 else 11 if until == 20 else 20))).coalesce(1).write.parquet(part)
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(f"{path}-clocks")
        out = T.vector_clocks(spark.readStream.schema(df.schema).parquet(f"{path}-clocks"))
        T.run_to_end(out.writeStream.outputMode("append").foreachBatch(lambda b, _: clocks.update({(r["meeting_id"], r["seq"]): json.loads(r["result"]) for r in b.collect()})), checkpoint)
    assert clocks == {(r["meeting_id"], r["seq"]): r["vclock"] for r in E.with_clocks(df).collect()}


def test_counters_latencies_and_windows(spark):
    rows = [("abc"[i % 3], i % 20, 1_704_067_200 + 20 * i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, value long, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    end = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200 + 90_000))).withColumn("seq", F.lit(-1).cast("long")).select(*df.columns)
    parts = [*halves(df, 150), end]
    window = F.window("ts", "10 minutes")["start"].alias("ts")
    want = {tuple(r) for r in df.groupBy(window, "label").agg(F.count("*"), F.sum("value")).collect()}
    assert {tuple(r) for r in streamed(parts, lambda s: T.counts(s, 10))} == want
    bounds = [1.0, 5.0]
    want = {tuple(r) for r in slo.histogram(df.select(window, "label", "value"), bounds, "ts", "label").collect()}
    assert {tuple(r) for r in streamed(parts, lambda s: T.latencies(s, 10, bounds))} == want
    texts = df.select(F.col("label").alias("meeting_id"), "seq", F.col("ts").alias("arrived_at"), F.concat(F.lit("t"), "seq").alias("redacted_text"))
    want = {(r["meeting_id"], r["start"], tuple(r["texts"])) for r in culture_windows(texts).collect()}
    more = [p.select(F.col("label").alias("meeting_id"), "seq", F.col("ts").alias("arrived_at"), F.concat(F.lit("t"), "seq").alias("redacted_text")) for p in parts]
    assert {(r["meeting_id"], r["start"], tuple(r["texts"])) for r in streamed(more, T.culture_windows)} == want


def test_heartbeats_count_with_the_events(spark):
    rows = [("m", f"t{i}", 1_704_067_200 + i, f"p{i}") for i in range(4)] + [("", "lost", 1_704_067_200, "x"), (None, "lost", 1_704_067_200, "x")]
    df = spark.createDataFrame(rows, "meeting_id string, type string, t long, payload string").withColumn("ts", F.timestamp_seconds("t"))
    got = running(df, lambda s: T.live_log(s, 1, 600), "append", lambda rows: len(rows) >= 7)
    assert [r["seq"] for r in got] == list(range(1, len(got) + 1)) and {r["meeting_id"] for r in got} == {"m"}
    assert [r["type"] for r in got[:4]] == ["t0", "t1", "t2", "t3"] and {r["type"] for r in got[4:]} == {"heartbeat"} and len(got) >= 7
    assert [r["ts"] for r in got[4:]] == sorted(r["ts"] for r in got[4:])
    few = running(df, lambda s: T.live_log(s, 1, 1), "append", lambda rows: False, limit=12)
    assert 5 <= len(few) <= 7


def moody():
    """Fails on a window that says so; otherwise says which texts it was asked about. It is made here, so that workers needn't know this file."""

    def classify(meeting, texts, hint):
        if "fail" in texts:
            raise OSError("away")
        return ["direct", "loud"] if hint is None else ["formal"], f"{meeting}:{','.join(texts)}"

    return lambda: classify


def test_culture_keeps_its_last_answer(spark):
    rows = [("m", 0, ["a"], None), ("m", 10, ["b"], None), ("m", 40, ["c"], "ja"), ("m", 80, ["fail"], None), ("m", 95, ["d"], None), ("m", 120, ["e"], None), ("k", 0, ["fail"], None), ("k", 30, ["f"], None)]
    df = spark.createDataFrame(rows, "meeting_id string, seq long, texts array<string>, lang_hint string").withColumn("start", F.timestamp_seconds(F.col("seq") + 1_704_067_200))
    want = {("m", 0): (["direct"], "m:a"), ("m", 10): (["direct"], "m:a"), ("m", 40): (["formal"], "m:c"), ("m", 80): (["formal"], "m:c"), ("m", 95): (["formal"], "m:c"), ("m", 120): (["direct"], "m:e"), ("k", 0): ([], None), ("k", 30): (["direct"], "k:f")}
    for parts in ([df], halves(df, 40), halves(df, 85)):
        got = streamed(parts, lambda s: T.culture(s, moody()))
        assert {(r["meeting_id"], int(r["start"].timestamp()) - 1_704_067_200): (r["tags"], r["note"]) for r in got} == want
    apart = df.where("seq not in (10, 95)")
    got = M.culture(apart, moody()).collect()
    assert {(r["meeting_id"], int(r["start"].timestamp()) - 1_704_067_200): (r["tags"], r["note"]) for r in got} == {k: v for k, v in want.items() if k[1] not in (10, 95)}
    asked = M.prompt(["x", "é"], "ja")
    assert asked[-1] == {"role": "user", "content": 'Utterances (language hint: ja): ["x", "é"]'} and asked[0]["role"] == "system"


def test_consensus_asks_the_state_once_a_speaker():
    calls = []

    one = T.ConsensusProcessor()
    held = {}

    class Value:
        exists = staticmethod(lambda: "v" in held)
        get = staticmethod(lambda: held["v"])
        update = staticmethod(lambda v: held.__setitem__("v", v))

    class Speakers:
        containsKey = staticmethod(lambda k: calls.append("has") or k in held)
        getValue = staticmethod(lambda k: calls.append("get") or held[k])
        updateValue = staticmethod(lambda k, v: calls.append("update") or held.__setitem__(k, v))

    one.meeting, one.speaker = Value, Speakers
    rows = pd.DataFrame({"meeting_id": "m", "speaker_id": ["a", "b", "a", "b"] * 50, "seq": range(200), "vec": [[float(i % 7), 1.0] if i % 5 else None for i in range(200)]})
    whole = pd.concat(one.handleInputRows(("m",), iter([rows]), None))
    assert len(calls) <= 6
    held.clear()
    parts = [next(one.handleInputRows(("m",), iter([rows[i : i + 40]]), None)) for i in range(0, 200, 40)]
    assert pd.concat(parts).reset_index(drop=True).equals(whole.reset_index(drop=True))
