from pyspark.sql import functions as F

from colloquy.functions import clocks as K
from colloquy.operators import events as E
from colloquy.operators import shards as S
from colloquy.operators import slo
from colloquy.sources.shared import fresh


def clock(**n):
    return F.map_from_arrays(F.array(*map(F.lit, n)), F.array(*[F.lit(v).cast("bigint") for v in n.values()]))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clock_relations(spark):
    assert value(spark, K.before(clock(alice=2), clock(alice=2, bob=1)))
    assert value(spark, K.concurrent(clock(alice=1), clock(bob=1)))
    assert not value(spark, K.before(clock(alice=2), clock(alice=2)))
    assert value(spark, K.merge(clock(alice=2), clock(alice=2))) == {"alice": 2}
    assert value(spark, K.rank(K.merge(clock(alice=3), clock(bob=2)))) == 5 == value(spark, K.rank(K.merge(clock(bob=2), clock(alice=3))))
    assert value(spark, K.clock_hash(clock(user=1))) == "104026530530793552"
    assert value(spark, K.clock_hash(clock(assistant=1, user=1))) == "18406564718894992038"


def test_resume_positions(spark):
    df = spark.range(140, 150).select(F.col("id").alias("seq"))
    assert [E.resume_after(df, x).count() for x in ("143", "", "abc", None)] == [6, 10, 10, 10]


def test_shard_edges(spark):
    rows = [("m", "a", i, 0.0 + i / 100) for i in range(51)] + [("m", "b", 99, 9.999), ("m", "b", 100, 10.0)]
    df = spark.createDataFrame(rows, "meeting_id string, speaker_id string, seq long, t double").select("*", F.timestamp_millis((F.col("t") * 1000).cast("bigint")).alias("arrived_at"), F.lit("x").alias("redacted_text"), clock(a=1).alias("vclock"))
    docs = S.shard_documents(S.assign_shards(df)).orderBy("start_ts").collect()
    assert [d["write_count"] for d in docs] == [50, 2, 1]
    doubled = S.shard_documents(S.assign_shards(df))
    assert S.export(doubled.unionByName(doubled)).count() == 53


def test_dead_letters(spark):
    lines = spark.createDataFrame([('{"meeting_id":"m","seq":1,"ts":"2024-01-01T00:00:00Z","payload":"{\\"text\\":\\"hi\\"}"}',), ('{"meeting_id":"m","se',)], "value string")
    good, bad = S.replay(lines, "text string")
    assert [(r["meeting_id"], r["p"]["text"]) for r in good.collect()] == [("m", "hi")] and bad.count() == 1
    path = fresh(spark, "dead")
    S.write_dead_letters(spark.createDataFrame([("m", 1, "x")], "meeting_id string, seq long, text string").withColumn("arrived_at", F.current_timestamp()), path)
    assert spark.read.json(path).count() == 1


def test_failure_bursts(spark):
    def tripped(pattern):
        rows = [(i, c == "F") for i, c in enumerate(pattern)]
        df = spark.createDataFrame(rows, "seq long, failed boolean").withColumn("ts", F.timestamp_seconds("seq"))
        return slo.failure_bursts(df).first()["tripped"]

    assert tripped("FFFFF") and tripped("FFSFFSFFSF") and not tripped("FFSFFSFSFS")


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "meeting_id string, speaker_id string, seq long, arrived_at timestamp")
    assert E.with_clocks(none).count() == 0 and slo.quantile(slo.histogram(none.selectExpr("'x' label", "1.0 value"), [1.0], "label"), 0.5, "label").count() == 0
