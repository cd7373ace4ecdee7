"""Streaming forms run over whole tables, held against the statements of their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans import consensus as batch
from colloquy.plans import events as batch_events
from colloquy.sources.adapters import envelopes, utterances
from colloquy.sources.shared import fresh
from colloquy.streaming import stateful as T


def _staged(df: DataFrame, files: int, key: str = "meeting_id") -> str:
    """The rows as files written one after another, those of _file 0 first, as they would arrive. A key's rows of a part share a file."""
    path = fresh(df.sparkSession, "stream-in")
    for k in range(files):
        df.where(F.col("_file") == k).drop("_file").repartition(key).write.mode("append").parquet(path)
    return path


def _collected(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out = fresh(spark, "stream-out")
    T.run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", out), fresh(spark, "stream-checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


def stream_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors arrive in two parts: the first ten rows of each meeting, then the rest."""
    v = batch._gappy(spark, sf_dir).withColumn("_file", F.when(F.col("seq") <= 10, 0).otherwise(1))
    stream = T.replayed(spark, _staged(v, 2), "meeting_id string, speaker_id string, seq bigint, vec array<double>")
    return batch._rounded(_collected(T.consensus(stream)).select("meeting_id", "speaker_id", "seq", "score", "delta", "drift", "stale"))


def stream_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).select("meeting_id", "speaker_id", "seq", F.when(F.col("seq") <= 2, 0).otherwise(1).alias("_file"))
    stream = T.replayed(spark, _staged(u, 2), "meeting_id string, speaker_id string, seq bigint")
    return _collected(T.vector_clocks(stream)).select("meeting_id", "seq", F.col("result").alias("vclock"))


def _in_slices(slices: list[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What made() of a stream gives when the slices arrive one after another: each is one micro-batch, however many files it has."""
    spark = slices[0].sparkSession
    path, out, checkpoint = (fresh(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    for part in slices:
        part.write.mode("append").parquet(path)
        stream = made(spark.readStream.schema(part.schema).parquet(path))
        T.run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of the table. Events arrive in slices of time; a last row two hours on lets the watermark pass all windows."""
    m = envelopes(spark, sf_dir).select(F.col("arrived_at").cast("timestamp").alias("ts"), F.col("type").alias("label"))
    last = m.agg(F.max("ts")).first()[0]
    early = F.coalesce(F.col("ts") < F.lit(last) - F.expr("INTERVAL 15 DAYS"), F.lit(False))
    end = m.agg((F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts")).withColumn("label", F.lit(None).cast("string"))
    return _in_slices([m.where(early), m.where(~early), end], lambda stream: T.rates(stream, 60)).withColumn("rate", F.round("rate", 9))


QUERIES = {f.__name__: f for f in (stream_consensus, stream_clocks, stream_rates)}
ORACLES = {
    "stream_consensus": batch.ORACLES["consensus_scores"],
    "stream_clocks": batch_events.ORACLES["vector_clocks"],
    "stream_rates": f"SELECT date_trunc('hour', ts) AS ts, {batch_events._T} AS label, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM events GROUP BY 1, 2",
}
